"""Pinned small cases: times, canonical stops, medians, headways, walks, patterns, hubs, search."""

import pytest
from pyspark.sql import functions as F

from tramline.functions import geo, lines, times
from tramline.operators.ordered import islands, lower_median
from tramline.plans import graphs, timetable
from tramline.plans.raptor import best_options, raptor, station_walks


def clock(spark, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(times.time_to_seconds(F.col("t"))).collect()]


def test_clock_times(spark):
    assert clock(spark, "08:30:05", "24:10:05", "12:60:00", "1:2", "", None, "x:00:00") == [30605, 87005, None, None, None, None, None]
    df = spark.createDataFrame([(87005,), (0,), (360000,)], "s int")
    assert [r[0] for r in df.select(times.seconds_to_time(F.col("s"))).collect()] == ["24:10:05", "00:00:00", "100:00:00"]


def test_projections(spark):
    row = spark.range(1).select(*geo.laea_to_wgs84(F.lit(3962799.45), F.lit(2999718.85)), *geo.utm32_to_wgs84(F.lit(500000.0), F.lit(5538630.703))).first()
    assert row[0] == pytest.approx(50, abs=1e-7) and row[1] == pytest.approx(5, abs=1e-7)
    assert row[2] == pytest.approx(50, abs=1e-6) and row[3] == pytest.approx(9)


def test_line_names(spark):
    df = spark.createDataFrame([("U1",), (" s3",), ("RB81",), ("A11",), ("A4",), ("SEV U1",), (None,)], "n string")
    assert [r[0] for r in df.select(lines.family(F.col("n"))).collect()] == ["u_bahn", "s_bahn", "regional", "a_line", None, None, None]
    colours = spark.createDataFrame([("##00aaFF",), ("00aaF",), ("",), (None,)], "c string")
    assert [r[0] for r in colours.select(lines.hex_colour(F.col("c"))).collect()] == ["#00AAFF", None, None, None]


def test_lower_median(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([1, 4],), ([None, 5],), ([],)], "v array<int>")
    assert [r[0] for r in df.select(lower_median(F.col("v"))).collect()] == [2, 2, 5, None]


def test_islands(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([("t", i, v) for i, v in enumerate("aabba")], "k string, i int, v string")
    changed = F.lag("v").over(Window.partitionBy("k").orderBy("i")) != F.col("v")
    assert [r.island for r in islands(df, ["k"], [F.col("i")], changed).orderBy("i").collect()] == [1, 1, 2, 2, 3]


def test_canonical_stops(spark):
    stops = spark.createDataFrame([("child-1", "parent-1", 1.0, 2.0), ("child-2", "parent-1", 3.0, 4.0), ("stop-a", None, 5.0, 6.0), (None, None, 7.0, 8.0)], "stop_id string, parent_station string, stop_lat double, stop_lon double")
    got = {r.canonical: (r.lat, r.lon) for r in timetable.canonical_coordinates(stops).collect()}
    assert got == {"parent-1": (1.0, 2.0), "stop-a": (5.0, 6.0)}


def walks(spark, coords, **options):
    return {(r.from_stop, r.to_stop): r.seconds for r in graphs.walk_edges(spark.createDataFrame(coords, "stop string, lat double, lon double"), **options).collect()}


def test_walk_edges(spark):
    got = walks(spark, [("A", 53.55, 9.993), ("B", 53.551, 9.993)], max_metres=200, speed=1.0)
    assert set(got) == {("A", "B"), ("B", "A")} and 100 <= got["A", "B"] <= 120
    with pytest.raises(ValueError):
        walks(spark, [("A", 53.55, 9.993)], speed=0)
    assert walks(spark, [("A", 53.55, 9.993), ("B", 53.551, 9.993)], max_metres=0) == {}


def test_walk_cap_counts_after_existing(spark):
    existing = spark.createDataFrame([("A", "B")], "from_stop string, to_stop string")
    got = walks(spark, [("A", 53.55, 9.993), ("B", 53.5506, 9.993), ("C", 53.5512, 9.993)], max_metres=200, speed=1.0, max_neighbours=1, existing=existing)
    assert {b for a, b in got if a == "A"} == {"C"} and sum(a == "B" for a, _ in got) == 1


def feed(spark, rows):
    """rows: trip, route, [(stop, arr, dep), ...] in seconds."""
    valid = spark.createDataFrame([(t, i, s, a, d) for t, _, calls in rows for i, (s, a, d) in enumerate(calls)], "trip_id string, pos int, stop string, arr int, dep int")
    trips = spark.createDataFrame([(t, r, 0) for t, r, _ in rows], "trip_id string, route_id string, direction_id int")
    return valid, timetable.trip_patterns(valid, trips)


def search(spark, rows, source, target, depart, paths=(), **options):
    valid, patterns = feed(spark, rows)
    q = spark.createDataFrame([(1, depart)], "query_id long, depart int")
    end = lambda stops: spark.createDataFrame([(1, s, n) for s, n in stops], "query_id long, stop string, seconds int")
    p = spark.createDataFrame(list(paths), "from_stop string, to_stop string, seconds int")
    return raptor(q, end(source), end(target), valid, patterns, p, **options)


H = 3600


def test_search_direct_and_unreachable(spark):
    rows = [("t", "r", [("A", 9 * H, 9 * H), ("B", 9 * H + 600, 9 * H + 600), ("C", 9 * H + 1200, 9 * H + 1200)])]
    assert [(r["round"], r.arrival) for r in search(spark, rows, [("A", 0)], [("C", 0)], 9 * H).collect()] == [(1, 9 * H + 1200)]
    assert search(spark, rows, [("A", 0)], [("X", 0)], 9 * H).count() == 0


def test_search_pareto_options(spark):
    rows = [("slow", "r0", [("A", 9 * H, 9 * H), ("D", 10 * H, 10 * H)]), ("ab", "r1", [("A", 9 * H, 9 * H), ("B", 9 * H + 300, 9 * H + 300)]), ("bd", "r2", [("B", 9 * H + 600, 9 * H + 600), ("D", 9 * H + 2700, 9 * H + 2700)]), ("bc", "r3", [("B", 9 * H + 400, 9 * H + 400), ("C", 9 * H + 700, 9 * H + 700)]), ("cd", "r4", [("C", 9 * H + 800, 9 * H + 800), ("D", 9 * H + 1800, 9 * H + 1800)])]
    options = search(spark, rows, [("A", 0)], [("D", 0)], 9 * H)
    assert sorted((r.transfers, r.arrival - 9 * H) for r in options.collect()) == [(0, 3600), (1, 2700), (2, 1800)]
    assert best_options(options).first()["round"] == 3
    assert search(spark, rows, [("A", 0)], [("D", 0)], 9 * H, max_rounds=1).first().arrival == 10 * H


def test_search_walks_and_waits(spark):
    rows = [("t", "r", [("B", 9 * H + 1800, 9 * H + 1800), ("C", 9 * H + 2400, 9 * H + 2400)])]
    paths = [("A", "B", 60), ("C", "D", 90)]
    assert search(spark, rows, [("A", 0)], [("D", 0)], 9 * H, paths).count() == 0
    assert search(spark, rows, [("A", 0)], [("D", 0)], 9 * H, paths, max_wait=1800).first().arrival == 9 * H + 2490
    assert search(spark, rows, [("A", 0)], [("B", 5)], 9 * H, paths).first().arrival == 9 * H + 65


def test_station_walks(spark):
    paths = spark.createDataFrame([("A", "B", 10), ("B", "C", 10), ("A", "C", 50)], "from_stop string, to_stop string, seconds int")
    assert {(r.from_stop, r.to_stop): r.seconds for r in station_walks(paths).collect()}["A", "C"] == 20
    assert {(r.from_stop, r.to_stop) for r in station_walks(paths, 15).collect()} == {("A", "B"), ("B", "C")}
