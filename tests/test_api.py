"""The feed object over the adapter's tables."""

import pytest
from pyspark.sql import functions as F

from tramline.api import Engine, Options, floor_space_density, population_grid
from tramline.plans.adapter import tables
from tramline.plans.surfaces import floor_space_grid

DIR = "/root/testdata/sf0.001"
FIELDS = ", ".join(f"{s}_id string, {s}_name string, {s}_lat double, {s}_lon double" for s in ("origin", "destination"))


@pytest.fixture(scope="module")
def engine(spark):
    names = ("stops", "routes", "trips", "stop_times", "transfers", "shapes")
    return Engine(spark, dict(zip(names, tables(spark, DIR, *names))), "demo", Options(max_transfers=1))


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), f"query_id long, depart string, {FIELDS}")


def test_routes_by_id_name_and_place(spark, engine):
    none = (None, None)
    got = engine.route(requests(spark, (1, "06:00:00", "S0", None, *none, "S4", None, *none), (2, "06:00:00", None, "stop 0", *none, None, " STOP 4 ", *none), (3, "06:00:00", None, None, 53.4005, 9.8, "S4", None, *none))).collect()
    arrival = {r.query_id: r.arrival for r in got if r.best}
    assert arrival[1] == arrival[2] and set(arrival) == {1, 2, 3}
    assert all(r.transfers <= 1 for r in got) and sum(r.best for r in got) == 3
    for r in got:
        assert r.n_rides == len(r.colours) == r["round"] and len(r.legs) >= 1 and r.fewest <= r.transfers
    assert any(r.legs[0].startswith("__origin__ -> ") for r in got if r.query_id == 3)
    layers = engine.map_layers(requests(spark, (1, "06:00:00", "S0", None, *none, "S4", None, *none))).collect()
    assert layers and {r.layer for r in layers} <= {"ride", "walk", "transfer", "stop"} and all(r.feature.startswith('{"type":') for r in layers)


def test_bad_requests_are_answers_among_others(spark, engine):
    none = (None, None)
    bad = [(1, "6:0", "S0", None, *none, "S4", None, *none), (2, "06:00:00", "S0", None, 53.4, 9.8, "S4", None, *none), (3, "06:00:00", None, None, 53.4, None, "S4", None, *none), (4, "06:00:00", "S0", None, *none, None, "nowhere", *none)]
    good = (5, "06:00:00", "S0", None, *none, "S4", None, *none)
    got = engine.route(requests(spark, *bad, good)).collect()
    assert {(r.query_id, r.status) for r in got} == {(1, 400), (2, 400), (3, 400), (4, 404), (5, 200)}
    assert all(bool(r.error) == (r.query_id != 5) and (r.arrival is None) == (r.query_id != 5) for r in got)
    alone = {(r.place, r.arrival, tuple(r.legs)) for r in engine.route(requests(spark, good)).collect()}
    assert {(r.place, r.arrival, tuple(r.legs)) for r in got if r.query_id == 5} == alone
    assert [r.status for r in engine.checked(requests(spark, *bad, good)).orderBy("query_id").collect()] == [400, 400, 400, 200, 200]
    with pytest.raises(ValueError):
        Options(walk_speed=0)
    assert Options().merged(horizon=None, max_wait=5) == Options(max_wait=5)


def test_search_over_graphs(spark, engine):
    none = (None, None)
    some = requests(spark, (1, "06:00:00", "S0", None, *none, "S4", None, *none), (2, "x", "S0", None, *none, "S4", None, *none))
    for method in ("trip_stop_anytime", "multi_edge"):
        got = engine.search_graph(some, method).orderBy("pos").collect()
        assert {r.query_id for r in got} == {1} and got[0].from_stop == "S0" and got[-1].to_stop == "S4"
        assert all(a.to_stop == b.from_stop and a.arr <= b.arr for a, b in zip(got, got[1:]))
    with pytest.raises(ValueError):
        engine.search_graph(some, "other")


def test_tables_are_kept_by_the_options_they_need(engine):
    first = engine.preload()
    assert engine.with_options(max_wait=600, horizon=None).preload() is first and engine.with_options(max_wait=600).options.max_wait == 600
    slow = engine.with_options(walk_metres=50_000)
    other = slow.preload()
    assert other is not first and engine.with_options(walk_metres=50_000).preload() is other and engine.preload() is first
    assert other["paths"].filter("is_walk").count() > first["paths"].filter("is_walk").count()
    assert slow.preload(rebuild=True) is not other


def test_layers(spark, engine):
    assert engine.status()["feed"] == "demo"
    lines = engine.network_lines().orderBy("rank").collect()
    assert [r["rank"] for r in lines] == list(range(1, len(lines) + 1)) and lines[0].family == "u_bahn"
    assert {r.family for r in engine.network_lines(True).collect()} <= {"u_bahn", "s_bahn"}
    cells, buildings = tables(spark, DIR, "cells", "buildings")
    assert population_grid(cells, 2021).first().geometry.startswith('{"type":"Polygon"')
    grid = floor_space_grid(buildings, "LoD1-DE_HH_2023-04-01")
    assert floor_space_density(grid, (53.0, 9.0, 54.0, 11.0)).count() == grid.count()
    assert grid.agg(F.round(F.sum("people"))).first()[0] == 1_850_000
    with pytest.raises(ValueError):
        population_grid(cells, 2021, (54.0, 9.0, 53.0, 11.0))
