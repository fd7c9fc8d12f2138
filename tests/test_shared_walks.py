"""Label-correcting search: walks that queries share, and candidates looked for in what was found."""

import random

import pytest

from tramline.plans import search

MOVE = "from_stop string, to_stop string, weight int, apply_penalty boolean"
RIDE = "from_stop string, to_stop string, dep int, arr int, trip_id string, route_id string"


def test_walks_from_one_stop_are_found_once(spark, monkeypatch):
    chain = [f"W{i}" for i in range(5)]
    moves = spark.createDataFrame([(a, b, 60, True) for a, b in zip(chain, chain[1:])] + [("W4", "R", 60, True)], MOVE)
    rides = spark.createDataFrame([("R", "Z", 5_000, 5_100, "t", "r")], RIDE)
    queries = spark.createDataFrame([(q, "W0" if q < 30 else "W4", 4_000 + q) for q in range(40)], "query_id long, stop string, depart int")
    grown, seen = search._grown, []

    def counted(made, steps, front, *rest, **options):
        out = grown(made, steps, front, *rest, **options)
        seen.append((front.select("query_id").distinct().count(), sum(t.count() for t in out)))
        return out

    monkeypatch.setattr(search, "_grown", counted)
    got = search.labels(queries, rides, moves, horizon=250, penalty=0).collect()
    # Two first stops' walks (W0 to W4, W4 to R); only the ten that meet R's ride go their own ways.
    assert seen == [(2, 5 + 2), (10, 20)]
    want = {(q, f"W{i}", 4_000 + q + 60 * i) for q in range(30) for i in range(5)} | {(q, s, 4_000 + q + d) for q in range(30, 40) for s, d in (("W4", 0), ("R", 60))}
    assert {(r.query_id, r.stop, r.t) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("few, route_penalty, goal", [(0, 0, False), (0, 50, True), (200_000, 50, True)])
def test_labels_are_the_same_however_they_are_compared(spark, monkeypatch, few, route_penalty, goal):
    rnd = random.Random(5)
    stops = [f"S{i}" for i in range(12)]
    rides, moves = [], {}
    for n in range(80):
        a, b = rnd.sample(stops[:6], 2)
        dep = rnd.randrange(0, 3000)
        rides.append((a, b, dep, dep + rnd.randrange(0, 500), f"t{n}", f"r{n % 4}"))
    for a, b in list(zip(stops, stops[1:] + stops[:1])) + [rnd.sample(stops, 2) for _ in range(6)]:
        moves.setdefault((a, b), rnd.choice([30, 200, 600]))
    asked = [(q, rnd.choice(stops), rnd.randrange(0, 1500)) for q in range(25)]
    ends = [(q, rnd.choice(stops)) for q, *_ in asked]
    want = {q: plain(rides, moves, stop, depart, route_penalty) for q, stop, depart in asked}
    monkeypatch.setattr(search, "FEW", few)
    monkeypatch.setattr(search, "TABLES", 3)
    goals = spark.createDataFrame(ends, "query_id long, stop string")
    found = search.labels(spark.createDataFrame(asked, "query_id long, stop string, depart int"), spark.createDataFrame(rides, RIDE), spark.createDataFrame([(a, b, w, True) for (a, b), w in moves.items()], MOVE), goals if goal else None, horizon=2000, max_wait=300, penalty=10, route_penalty=route_penalty)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add((r.step, r.stop, r.active, r.t))
    if not goal:
        assert got == want
        return
    for q, end in ends:
        best = min((t for _, s, _, t in want[q] if s == end), default=None)
        assert min((t for _, s, _, t in got.get(q, ()) if s == end), default=None) == best
    way = {}
    for h in search.hops(found, goals).collect():
        way.setdefault(h.query_id, []).append((h.pos, h.from_stop, h.to_stop, h.arr))
    for q, end in ends:
        best = min((t for _, s, _, t in want[q] if s == end), default=None)
        assert (sorted(way[q])[-1][2:] if q in way else None) == ((end, best) if best is not None and asked[q][1] != end else None)


def plain(rides, moves, start, depart, change):
    """(step, stop, active, t) of all labels that were an improvement when found."""
    best, front, out, n = {(start, None): depart}, {(start, None): depart}, {(0, start, None, depart)}, 0
    while front:
        n, new = n + 1, {}
        for (stop, active), t in front.items():
            onward = [(t + w + 10, b, None) for (a, b), w in moves.items() if a == stop]
            first = {}
            for a, b, dep, arr, trip, route in rides:
                if a == stop and t <= dep <= min(t + 300, depart + 2000):
                    first[b] = min(first.get(b, (dep, trip, arr, route)), (dep, trip, arr, route))
            onward += [(arr + (change if active is not None and active != route else 0), b, route if change else None) for b, (_, _, arr, route) in first.items()]
            for u, b, on in onward:
                if u <= depart + 2000 and u < min(best.get((b, on), 1 << 30), new.get((b, on), 1 << 30)):
                    new[b, on] = u
        best.update(new)
        out |= {(n, s, on, u) for (s, on), u in new.items()}
        front = new
    return out


def test_departures_of_one_time_are_one(spark):
    rides = spark.createDataFrame([("A", "B", 600, 700 + i % 2, f"t{i:02}", "r") for i in range(40)], RIDE)
    assert [[tuple(d) for d in r.deps] for r in search.departure_bins(rides, 1200).collect()] == [[(600, "t00", 700, "r")]] * 2
