"""Searches over stops that lie no time apart, against the same searches stop by stop."""

import random

import pytest

from tramline.plans import timetable
from tramline.plans.raptor import between_groups, boardings, group_paths, journeys, search, station_walks, still_groups

PATH = "from_stop string, to_stop string, seconds int, is_walk boolean"


def test_groups_are_rings_of_no_time(spark):
    ring = [(f"S{i:02}", f"S{(i + 1) % 20:02}", 0, False) for i in range(20)]
    more = [("S03", "T0", 0, False), ("T0", "T1", 0, False), ("T1", "T0", 0, False), ("T1", "T2", 0, False), ("T2", "S00", 5, False), ("U0", "U1", 0, True), ("U1", "U0", 0, True), ("V0", "V0", 0, False)]
    paths = spark.createDataFrame(ring + more, PATH)
    groups = still_groups(paths)
    assert {(r.stop, r.grp) for r in groups.collect()} == {(a, "S00") for a, *_ in ring} | {("T0", "T0"), ("T1", "T0")}
    got = {tuple(r) for r in group_paths(paths, groups).select("from_stop", "to_stop", "seconds", "is_walk").collect()}
    assert got == {("S00", "T0", 0, False), ("T0", "T2", 0, False), ("T2", "S00", 5, False), ("U0", "U1", 0, True), ("U1", "U0", 0, True)}
    # A ring whose stops pick other ways first is found once those are one.
    eight = spark.createDataFrame([("A", "B", 0, False), ("B", "A", 0, False), ("B", "C", 0, False), ("C", "B", 0, False), ("C", "D", 0, False)], PATH)
    assert {(r.stop, r.grp) for r in still_groups(eight).collect()} == {(x, "A") for x in "ABC"}
    assert still_groups(spark.createDataFrame([("A", "B", 0, False)], PATH)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_grouped_search_equals_plain_search(spark, seed):
    rnd = random.Random(seed)
    stops = [f"S{i:02}" for i in range(18)]
    rings = [stops[:4], stops[4:7], stops[7:9]]
    paths = {(a, b): (0, False) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])}
    while len(paths) < 14:
        a, b = rnd.sample(stops, 2)
        paths.setdefault((a, b), (rnd.choice([0, 700, 1500]), rnd.random() < 0.5))
    paths = spark.createDataFrame([(a, b, *w) for (a, b), w in paths.items()], PATH)
    rows, trips = [], []
    for t in range(120):
        at, calls = 36_000 + rnd.randrange(0, 5400, 60), rnd.sample(stops, 4)
        trips.append((f"t{t:02}", f"r{t % 6}", 0))
        for pos, stop in enumerate(calls if t % 3 else stops[t % 5 : t % 5 + 4]):
            rows.append((f"t{t:02}", pos, stop, at, at + 30))
            at += rnd.choice([120, 180, 600])
    valid = spark.createDataFrame(rows, "trip_id string, pos int, stop string, arr int, dep int")
    trips = spark.createDataFrame(trips, "trip_id string, route_id string, direction_id int")
    asked = range(40)
    queries = spark.createDataFrame([(q, 36_000 + rnd.randrange(0, 3600, 60)) for q in asked], "query_id long, depart int")
    ends = lambda n: spark.createDataFrame([(q, s, rnd.choice([0, 0, 60, 400])) for q in asked for s in rnd.sample(stops, n)], "query_id long, stop string, seconds int")
    sources, targets = ends(2).localCheckpoint(), ends(2).localCheckpoint()
    plain = search(queries, sources, targets, valid, timetable.trip_patterns(valid, trips), station_walks(paths, 14_400), 5, closed=True)
    groups = still_groups(paths)
    few, between = between_groups(valid, groups), group_paths(paths, groups)
    patterns = timetable.trip_patterns(few, trips)
    got = search(queries, sources, targets, few, patterns, station_walks(between, 14_400), 5, closed=True, groups=groups)
    stepwise = search(queries, sources, targets, few, patterns, between, 5, groups=groups)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    options = rows(plain.options)
    assert groups.count() >= 9 and len(options) > 30 and max(r["round"] for r in plain.options.collect()) >= 2
    assert rows(got.options) == options and rows(stepwise.options) == options
    assert rows(journeys(got)) == rows(journeys(plain))
    # A group has one label, not one for each of its stops.
    whole = got.labels.filter("stop is null")
    assert whole.count() == whole.select("query_id", "round", "grp").distinct().count() > 0


def test_departures_of_one_time_are_boarded_once(spark):
    calls = [("p", f"t{i:02}", i, 0, "A", "A", 600, 600 + i % 2) for i in range(40)]
    calls = spark.createDataFrame(calls, "pattern string, trip_id string, trip_index int, pos int, stop string, grp string, arr int, dep int")
    deps = [[(d.dep, d.trip_id) for d in r.deps] for r in boardings(calls, 1200).collect()]
    assert deps == [[(600, "t00"), (601, "t01")]] * 2
