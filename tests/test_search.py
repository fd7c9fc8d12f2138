"""Search over edges, trips that overtake, nearest stops at any place, points on surfaces, as-of joins: small cases against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators.ordered import asof_forward
from tramline.plans import access, timetable
from tramline.plans.search import edge_labels, hops

EDGE = "from_stop string, to_stop string, kind string, weight int, headway int, dep int, arr int, trip_id string, route_id string, apply_penalty boolean"
H = 3600


def arrivals(spark, edges, start, depart, goal=None, **options):
    q = spark.createDataFrame([(1, start, depart)], "query_id long, stop string, depart int")
    goals = spark.createDataFrame([(1, goal)], "query_id long, stop string") if goal else None
    return edge_labels(q, spark.createDataFrame(edges, EDGE), goals, **options)


def at(found, stop):
    return min((r.t for r in found.collect() if r.stop == stop), default=None)


def ride(a, b, dep, arr, trip="t", route="r"):
    return (a, b, "trip", None, None, dep, arr, trip, route, None)


def every(a, b, weight, headway, trip="t", route="r"):
    return (a, b, "ride", weight, headway, None, None, trip, route, None)


def test_pinned_edges(spark):
    assert at(arrivals(spark, [("A", "B", "transfer", 60, None, None, None, None, None, True)], "A", 0, penalty=300), "B") == 360
    assert at(arrivals(spark, [("A", "B", "transfer", 60, None, None, None, None, None, False), ("B", "C", "walk", 5, None, None, None, None, None, True)], "A", 0, penalty=300), "C") == 65
    assert at(arrivals(spark, [ride("A", "B", 8 * H, 8 * H + 60)], "A", 9 * H), "B") is None
    assert at(arrivals(spark, [every("A", "B", 120, None)], "A", 9 * H), "B") == 9 * H + 120
    late = [ride("A", "B", 9 * H + 1800, 9 * H + 2000)]
    assert at(arrivals(spark, late, "A", 9 * H, max_wait=1200), "B") is None and at(arrivals(spark, late, "A", 9 * H, max_wait=1800), "B") == 9 * H + 2000
    unknown = [("A", "B", "ride", None, 600, None, None, "t", "r", None)]
    assert at(arrivals(spark, unknown, "A", 0), "B") is None and at(arrivals(spark, unknown, "A", 0, zero_missing=True), "B") == 300
    with pytest.raises(ValueError):
        arrivals(spark, unknown, "A", 0, state_by="stop")
    with pytest.raises(ValueError):
        arrivals(spark, unknown, "A", 0, max_wait=0)


def test_first_ride_of_a_route_over_all_targets(spark):
    edges = [ride("A", "B", 100, 150, "t1", "r"), ride("A", "C", 110, 120, "t2", "r"), ride("A", "C", 130, 140, "t3", "s")]
    by_route = arrivals(spark, edges, "A", 90)
    assert at(by_route, "B") == 150 and at(by_route, "C") == 140
    assert at(arrivals(spark, edges, "A", 90, state_by="trip"), "C") == 120
    # Neither route nor trip: all are taken.
    alone = [ride("A", "B", 100, 150, None, None), ride("A", "C", 110, 120, None, None)]
    assert at(arrivals(spark, alone, "A", 90), "C") == 120
    # A ride by headway leaves before the timed one of its route.
    mixed = [ride("A", "B", 500, 510), every("A", "C", 50, 101)]
    got = arrivals(spark, mixed, "A", 0)
    assert at(got, "C") == 100 and at(got, "B") is None


def plain_labels(edges, start, depart, horizon, max_wait, penalty, change, state_by, zero):
    """All improvements of (stop, active), step by step."""
    best, front = {(start, None): depart}, {(start, None): depart}
    while front:
        new = {}
        for (stop, active), t in front.items():
            if t > depart + horizon:
                continue
            groups, out = {}, []
            for n, (a, b, kind, w, hw, dep, arr, trip, route, pen) in enumerate(edges):
                if a != stop:
                    continue
                if kind not in ("trip", "ride"):
                    if w is not None or zero:
                        out.append((t + (w or 0) + (penalty if kind == "transfer" and pen is not False else 0), b, None))
                    continue
                if dep is not None and arr is not None:
                    if arr < dep or dep < t or (max_wait is not None and dep - t > max_wait):
                        continue
                    leaves, there = dep, arr
                else:
                    wait = hw // 2 if hw and hw > 0 else 0
                    if (w is None and not zero) or (max_wait is not None and wait > max_wait):
                        continue
                    leaves, there = t + wait, t + wait + (w or 0)
                first, second = (("route", route), ("trip", trip)) if state_by == "route" else (("trip", trip), ("route", route))
                key = first if first[1] is not None else second if second[1] is not None else n
                groups.setdefault(key, []).append((leaves, there, b, trip or "", route or "", trip, route))
            for rides in groups.values():
                _, there, b, _, _, trip, route = min(rides, key=lambda r: r[:5])
                on = route if state_by == "route" else trip
                out.append((there + (change if active is not None and trip is not None and on != active else 0), b, on if change else None))
            for u, b, on in out:
                if u < min(best.get((b, on), math.inf), new.get((b, on), math.inf)):
                    new[b, on] = u
        best.update(new)
        front = new
    out = {}
    for (stop, _), t in best.items():
        out[stop] = min(t, out.get(stop, math.inf))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_edges_equal_plain_search(spark, seed):
    rng = random.Random(seed)
    stops, edges = "ABCDEFG", []
    for n in range(60):
        a, b = rng.sample(stops, 2)
        trip, route = rng.choice([f"t{n}", f"t{n % 9}", None]), rng.choice(["r1", "r2", "r3", None])
        kind = rng.random()
        if kind < 0.5:
            dep = rng.randrange(0, 3000)
            edges.append(ride(a, b, dep, dep + rng.randrange(-20, 400), trip, route))
        elif kind < 0.75:
            edges.append(every(a, b, rng.choice([None, rng.randrange(0, 300)]), rng.choice([None, 0, 301, 900]), trip, route))
        else:
            edges.append((a, b, rng.choice(["transfer", "walk"]), rng.choice([None, 40, 200]), None, None, None, None, None, rng.choice([True, False, None])))
    for state_by, change, wait, zero in (("route", 0, 600, False), ("trip", 70, 600, True), ("route", 70, None, False)):
        got = {}
        for r in arrivals(spark, edges, "A", 10, horizon=2500, max_wait=wait, penalty=30, change_penalty=change, state_by=state_by, zero_missing=zero).collect():
            got[r.stop] = min(r.t, got.get(r.stop, math.inf))
        assert got == plain_labels(edges, "A", 10, 2500, wait, 30, change, state_by, zero)


def test_goal_and_hops(spark):
    edges = [every("A", "B", 100, 60), every("B", "C", 100, 60, "u", "s"), every("A", "C", 500, 0, "v", "w"), every("C", "D", 1, 0)]
    found = arrivals(spark, edges, "A", 0, "C", change_penalty=20)
    goals = spark.createDataFrame([(1, "C")], "query_id long, stop string")
    assert [(r.from_stop, r.to_stop, r.trip_id, r.arr) for r in hops(found, goals).orderBy("pos").collect()] == [("A", "B", "t", 130), ("B", "C", "u", 280)]


# --- trips that overtake ---


def test_overtaking_trips_make_chains(spark):
    rows = [("slow", 0, (0, 1000, 2000)), ("fast", 1, (10, 500, 900)), ("next", 2, (20, 1100, 2100)), ("tie", 3, (20, 1100, 2100)), ("fastest", 4, (30, 400, 800))]
    calls = spark.createDataFrame([("p", t, i, pos, c, c) for t, i, cs in rows for pos, c in enumerate(cs)], "pattern string, trip_id string, trip_index int, pos int, arr int, dep int")
    got = {(r.trip_id, r.chain) for r in timetable.trip_chains(calls).collect()}
    assert got == {("slow", 0), ("next", 0), ("tie", 0), ("fast", 1), ("fastest", 2)}
    with pytest.raises(ValueError):
        timetable.trip_chains(calls, max_chains=2)


def test_search_finds_the_trip_that_overtakes(spark):
    from .test_timetable import search

    rows = [("slow", "r", [("A", 9 * H, 9 * H), ("B", 10 * H, 10 * H)]), ("fast", "r", [("A", 9 * H + 60, 9 * H + 60), ("B", 9 * H + 600, 9 * H + 600)])]
    assert [(r["round"], r.arrival) for r in search(spark, rows, [("A", 0)], [("B", 0)], 9 * H).collect()] == [(1, 9 * H + 600)]


# --- nearest stops ---


def metres(a, b):
    (la, lo), (lb, lp) = ((math.radians(x) for x in p) for p in (a, b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * geo.EARTH_M * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def spots(spark, points, stops):
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "query_id long, lat double, lon double")
    return p, spark.createDataFrame([(f"s{i:05d}", *x) for i, x in enumerate(stops)], "stop_id string, lat double, lon double")


@pytest.mark.parametrize("reach", [500.0, 40_000.0])
def test_within_reach_at_all_latitudes(spark, reach):
    rng = random.Random(3)
    points, stops = [], []
    for lat in (0.0, 53.5, 60.0, 65.0, 70.0, 78.0, -78.0, 85.0, 89.2, 89.999, -89.9999, 90.0):
        for lon in (10.0, 179.9995, -180.0, 0.0):
            points.append((lat, lon))
            for _ in range(10):
                d, way = rng.uniform(0.5, 1.1) * reach / 111_195, rng.uniform(0, 2 * math.pi)
                la = lat + d * math.cos(way)
                lo = lon + min(d * abs(1 / max(1e-9, math.cos(math.radians(lat)))), 180) * math.sin(way)
                if abs(la) <= 90:
                    stops.append((la, (lo + 180) % 360 - 180))
    p, s = spots(spark, points, stops)
    got = {(r.query_id, r.stop_id) for r in access.within(p, s, reach).collect()}
    want = {(i, f"s{j:05d}") for i, a in enumerate(points) for j, b in enumerate(stops) if metres(a, b) <= reach}
    assert got == want and len(want) > 200


def test_nearest_at_any_place(spark):
    rng = random.Random(4)
    stops = [(53.5 + rng.uniform(-0.1, 0.1), 10 + rng.uniform(-0.1, 0.1)) for _ in range(300)] + [(53.5, 10.0)] * 3 + [(78.2, 15.6), (78.21, 15.7), (-17.0, 179.99), (-17.01, -179.99), (90.0, 0.0), (-89.9, 100.0)]
    points = [(53.5, 10.0), (53.55, 9.95), (0.0, 0.0), (60.0, 30.0), (78.0, 16.0), (-78.0, 15.0), (-17.0, 180.0), (-17.0, -179.999), (89.99, 170.0), (-90.0, 5.0), (12.3, -150.0)]
    p, s = spots(spark, points, [*stops, (None, 3.0)])
    p = p.union(spark.createDataFrame([(99, None, 1.0)], p.schema))
    for k in (1, 6, 400):
        got = {}
        for r in access.nearest(p, s, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.stop_id)
        for i, a in enumerate(points):
            near = sorted((round(metres(a, b), 3), f"s{j:05d}") for j, b in enumerate(stops))
            assert got[i] == [x for _, x in near][:k], (k, a)
        assert set(got) == set(range(len(points)))
    assert access.nearest(p, s, 2, 1000.0).filter("query_id = 2").count() == 0 and access.nearest(p, s.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        access.nearest(p, s, 0)


# --- points on surfaces ---


def test_points_lie_in_concave_outlines(spark):
    ring = lambda *ps: [(float(x), float(y)) for x, y in ps]
    ell, you = ring((0, 0), (10, 0), (10, 1), (1, 1), (1, 10), (0, 10)), ring((0, 0), (9, 0), (9, 9), (7, 9), (7, 1), (1, 1), (1, 9), (0, 9), (0, 0))
    hole = [ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((2, 2), (9, 2), (9, 9), (2, 9))]
    rows = [(0, [[ell]]), (1, [[you]]), (2, [hole]), (3, [[ell], [you]]), (4, [[ring((0, 0), (4, 0), (2, 6))]]), (5, [[ring((1, 1), (1, 1))]])]
    df = spark.createDataFrame(rows, "k int, p array<array<array<struct<x:double,y:double>>>>")
    got = {r.k: r.p for r in df.select("k", geo.point_on_surface(F.col("p")).alias("p")).collect()}
    assert (got[0].x, got[0].y, got[0].width) == (0.5, 5.5, 1.0)
    assert (got[1].x, got[1].width) == (8.0, 2.0)
    assert (got[2].x, got[2].width) == (1.0, 2.0)
    assert (got[3].x, got[3].width) == (8.0, 2.0)
    assert got[4].x == 2.0 and 0 < got[4].y < 6
    assert got[5] is None or got[5].width is None


# --- as-of ---


@pytest.mark.parametrize("within", [None, 0, 7, 1000])
def test_asof_equals_plain(spark, within):
    rng = random.Random(within or 5)
    left = [(i, rng.choice("abz"), rng.choice([None, *range(60)])) for i in range(80)] + [(200, None, 3)]
    right = [(rng.choice("ab"), rng.choice([None, *range(60)]), f"x{rng.randrange(40)}") for _ in range(90)] + [(None, 5, "n")]
    got = asof_forward(spark.createDataFrame(left, "i int, k string, at int"), spark.createDataFrame(right, "k string, t int, name string"), ["k"], "at", "t", ["name"], within).collect()
    want = {}
    for i, k, a in left:
        fits = [(t, n) for r, t, n in right if k is not None and a is not None and t is not None and r == k and t >= a and (within is None or t <= a + within)]
        if fits:
            want[i] = min(fits)
    assert {r.i: (r.t, r.name) for r in got} == want and len(got) == len(want)
