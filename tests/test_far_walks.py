"""Label-correcting search: walks that meet no ride any more are joined, not walked step by step; departures in short bins."""

from tramline.plans import search

EDGE = "from_stop string, to_stop string, kind string, weight int, headway int, dep int, arr int, trip_id string, route_id string, apply_penalty boolean"


def test_walks_beyond_the_last_ride_need_few_steps(spark, monkeypatch):
    chain = [f"C{i:02}" for i in range(80)]
    ride = lambda a, b, dep, arr, trip: (a, b, "trip", None, None, dep, arr, trip, trip, None)
    edges = [ride("A", "C00", 100, 200, "slow"), ride("A", "B", 50, 60, "t"), ride("B", "C00", 150, 180, "u")]
    edges += [(a, b, "walk", 10, None, None, None, None, None, None) for a, b in zip(chain, chain[1:])]
    edges, written, cut = spark.createDataFrame(edges, EDGE), [], search.cut
    monkeypatch.setattr(search, "cut", lambda df, name: written.append(name) or cut(df, name))
    queries = spark.createDataFrame([(1, "A", 0)], "query_id long, stop string, depart int")
    got = {(r.step, r.stop, r.t) for r in search.edge_labels(queries, edges, horizon=700, max_wait=300).collect()}
    # What ends after the horizon counts, but is not left.
    want = {(0, "A", 0), (1, "B", 60)} | {(1 + i, chain[i], 200 + 10 * i) for i in range(52)} | {(2 + i, chain[i], 180 + 10 * i) for i in range(54)}
    assert got == want and len(written) < 40  # there are 55 steps

    goals = spark.createDataFrame([(1, "C53")], "query_id long, stop string")
    found = search.edge_labels(queries, edges, goals, horizon=700, max_wait=300)
    way = sorted(search.hops(found, goals).collect())
    assert [h.to_stop for h in way] == ["B", *chain[:54]] and [h.pos for h in way] == list(range(55)) and way[-1].arr == 710


def test_next_departures_are_in_short_rows(spark):
    rides = spark.createDataFrame([("A", d, d) for d in (0, 130, 131, 500, 1790)], "stop string, dep int, d int")
    rows = {r.bin: list(r.deps) for r in search.next_bins(rides, ["stop"], 100, 400).collect()}
    for t in range(-400, 1800):
        want = next((d for d in (0, 130, 131, 500, 1790) if t <= d <= t + 400), None)
        assert next((d for d in rows.get(t // 100, []) if t <= d <= t + 400), None) == want
    assert max(map(len, rows.values())) == 3
