"""What larger tables brought to light: unknown first times, repeated cells, stops that share a place."""

from pyspark.sql import functions as F

from tramline.plans import surfaces, timetable


def test_headway_counts_from_the_first_known_time(spark):
    timed = spark.createDataFrame([("a", 1, 100), ("a", 2, 160), ("b", 1, None), ("b", 2, 400), ("c", 1, 1000)], "trip_id string, seq int, dep int")
    trips = spark.createDataFrame([(t, "r", "v", 0) for t in "abc"], "trip_id string, route_id string, service_id string, direction_id int")
    assert [(r.headway_sec, r.n) for r in timetable.headways(timed, trips).collect()] == [(450, 3)]


def test_rows_of_one_cell_are_merged(spark):
    at = "CRS3035RES1000mN3351000E4313000"
    rows = [(at, 2021, "7"), (at, 2021, "[0-3]"), (at, 2020, "5"), (at.replace("E4313", "E4314"), 2021, "3")]
    cells = spark.createDataFrame(rows, "grid_id string, dataset_year int, population_raw string").coalesce(1)
    got = surfaces.population_cells(cells, 2021, merged=True).orderBy("grid_id").collect()
    assert [(r.estimate, r.n, len(r.ring)) for r in got] == [(7.0, 2, 5), (3.0, 1, 5)]
    assert surfaces.population_cells(cells, 2021).count() == 3


def test_unions_of_whole_coordinates_stay_whole():
    from fractions import Fraction

    from tramline.functions import overlay

    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    rings, scale = overlay._scaled([box(0.0, 0.0, 4.5, 3.0), box(1.25, 1.0, 9.0, 1.0)])
    assert scale == 8 and all(isinstance(c, int) for r in rings for p in r for c in p)
    edges = [list(zip(r, r[1:] + r[:1])) for r in rings]
    met = [p for a in edges[0] for b in edges[1] for p in overlay._meetings(*a, *b)]
    assert met and all(isinstance(c, int) for p in met for c in p)
    tiny = overlay.united([[(0.0, 0.0), (2.0**-300, 0.0), (0.0, 2.0**-300)], [(0.0, 0.0), (2.0**-300, 2.0**-300), (2.0**-300, 0.0)]])
    assert sorted(tiny[0][0]) == [(0.0, 0.0), (0.0, 2.0**-300), (2.0**-301, 2.0**-301), (2.0**-300, 0.0), (2.0**-300, 2.0**-300)] and Fraction(1, 3) == overlay._over(1, 3)


def test_stops_and_points_that_share_places(spark):
    from tramline.plans import access

    stops = spark.createDataFrame([(f"s{i:02}", 53.5 + (i % 3) * 1e-3, 10.0) for i in range(30)], "stop_id string, lat double, lon double")
    points = spark.createDataFrame([(q, 53.5, 10.0) for q in range(5)] + [(9, None, None)], "query_id long, lat double, lon double")
    joined = access.within
    seen = []
    access.within = lambda p, s, m: seen.append((p.count(), s.count())) or joined(p, s, m)
    try:
        near = access.nearest_within(points, stops, 12, 900.0)
        got = [(r.query_id, r["rank"], r.stop_id) for r in near.orderBy("query_id", "rank").collect()]
    finally:
        access.within = joined
    assert seen == [(1, 3)]  # one place of points, three of stops
    first = [f"s{i:02}" for i in (*range(0, 30, 3), 1, 4)]
    assert got == [(q, i + 1, s) for q in range(5) for i, s in enumerate(first)]


def test_neighbours_of_points_that_share_places(spark):
    from tramline.operators import spatial

    rows = [(f"p{i:02}", float(i % 3) * 10, 0.0) for i in range(30)] + [("far", 500.0, 0.0)]
    points = spark.createDataFrame(rows, "id string, x double, y double")
    more = spark.createDataFrame([("p00", 2)], "id string, more int")
    whole, seen = spatial.grid_pairs, []
    spatial.grid_pairs = lambda p, r: seen.append(p.count()) or whole(p, r)
    try:
        got = {}
        for r in spatial.nearest_pairs(points, 25.0, 3, lambda s: F.round(s, 3), more).collect():
            got.setdefault(r.a, []).append((r.near, r.b))
    finally:
        spatial.grid_pairs = whole
    assert seen == [4] and "far" not in got  # places, not points
    for a, ax, _ in rows[:30]:
        want = sorted(((x - ax) ** 2, b) for b, x, _ in rows if 0 < abs(x - ax) <= 25)
        assert sorted(got[a]) == want[: 5 if a == "p00" or want[:5] == sorted(got[a]) else 3]
    assert len(got["p00"]) == 5 and len(got["p01"]) == 3


def test_patterns_alone_need_no_window(spark):
    rows = [(t, i, s, i * 60, i * 60) for t, stops in (("a", "XY"), ("b", "XY"), ("c", "XZ")) for i, s in enumerate(stops)]
    valid = spark.createDataFrame(rows, "trip_id string, pos int, stop string, arr int, dep int")
    trips = spark.createDataFrame([(t, "r", 0) for t in "abc"], "trip_id string, route_id string, direction_id int")
    alone = timetable.patterns_alone(valid, trips)
    assert "Window" not in alone._jdf.queryExecution().optimizedPlan().toString()
    every = timetable.trip_patterns(valid, trips).select("pattern", "stops").distinct().collect()
    assert sorted((r.pattern, r.stops) for r in alone.collect()) == sorted((r.pattern, r.stops) for r in every)


def test_trips_are_dealt_to_tasks_of_bounded_rows(spark, monkeypatch):
    from tramline import queries
    from tramline.plans import adapter

    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    monkeypatch.setattr(adapter, "TASK_ROWS", 500)
    rows = queries._pairs(spark, folder)
    assert rows.rdd.getNumPartitions() == 1 + n // 500 > 4  # not the session's number of shuffle partitions, whatever the size


def test_patterns_of_trips_need_no_window(spark):
    rows = [(t, i, s, i * 60, i * 60) for t, stops in (("a", "XY"), ("b", "XY"), ("c", "XZ")) for i, s in enumerate(stops)]
    valid = spark.createDataFrame(rows, "trip_id string, pos int, stop string, arr int, dep int")
    trips = spark.createDataFrame([(t, "r", 0) for t in "abc"], "trip_id string, route_id string, direction_id int")
    few = timetable.patterns_of_trips(valid, trips)
    assert "Window" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(few.collect()) == sorted(timetable.trip_patterns(valid, trips).select("trip_id", "pattern").collect())


def test_valid_trips_and_those_between_groups_are_read_once(spark):
    from tramline.plans.raptor import between_groups

    rows = [("a", 0, "A", 0, 1, 0), ("a", 1, "B", 5, 5, 0), ("back", 0, "A", 9, 9, 0), ("back", 1, "B", 3, 4, 0), ("one", 0, "A", 1, 1, 0), ("bad", 0, "A", 1, 1, 0), ("bad", 1, "B", 2, 2, 1), ("in", 0, "A", 1, 1, 0), ("in", 1, "C", 2, 2, 0)]
    merged = spark.createDataFrame(rows, "trip_id string, pos int, stop string, arr int, dep int, _bad int")
    valid = timetable.valid_trips(merged)
    assert {r.trip_id for r in valid.collect()} == {"a", "in"} and valid.columns == ["trip_id", "pos", "stop", "arr", "dep"]
    groups = spark.createDataFrame([("A", "A"), ("C", "A")], "stop string, grp string")
    between = between_groups(valid, groups)
    assert {r.trip_id for r in between.collect()} == {"a"} and between.columns == valid.columns
    plan = between._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the groups alone


def test_chains_compare_trips_block_by_block(spark, monkeypatch):
    import random

    rnd, rows = random.Random(5), []
    for p in "pq":
        for i in range(60):
            at = i * 20 + rnd.choice([0, 0, 300])
            for pos in range(3):
                rows.append((p, f"{p}{i:02}", i, pos, at, at + rnd.choice([5, 5, 90])))
                at += rnd.choice([100, 100, 160])
    calls = spark.createDataFrame(rows, "pattern string, trip_id string, trip_index int, pos int, arr int, dep int")
    want, left, n = {}, {t: [(a, d) for _, u, _, _, a, d in rows if u == t] for _, t, *_ in rows}, 0
    while left:
        ahead, behind = {}, {}
        for t in sorted(left):  # as trip_index goes
            late = any(x < y for u in ahead.get(t[0], []) for a, b in zip(left[t], u) for x, y in zip(a, b))
            ahead.setdefault(t[0], []).append(left[t])
            if late:
                behind[t] = left[t]
            else:
                want[t] = n
        left, n = behind, n + 1
    assert n > 3
    for size in (7, 1000):
        monkeypatch.setattr(timetable, "BLOCK_TRIPS", size)
        monkeypatch.setattr(timetable, "BLOCK_ROWS", 20)
        got = timetable.trip_chains(calls).select("trip_id", "chain").distinct().collect()
        assert sorted((r.trip_id, r.chain) for r in got) == sorted(want.items())
