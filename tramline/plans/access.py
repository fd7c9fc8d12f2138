"""Stops near coordinates, as ends of a search."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, haversine, walk_seconds
from ..operators.ordered import top_by
from ..shared import BROADCAST_ROWS, cut, join_counted, kept, passing

#: Metres of a degree of latitude, a little less than it has, so that what is near is never taken to be farther.
DEGREE_M = 111_000.0
#: What parts of millimetres distances are compared to, so that rounding decides nothing.
SLACK = 1e-3
#: Points a task looks up the hierarchy for, so what they open fits its memory.
POINTS = 2000


def _rows_of_cells(band: Column, metres: float) -> Column:
    """Number of cells round the globe in a band of latitude (metres high, counted from the equator): each as wide as a reach of
    metres spans at the outer edge of the next band, where degrees are shortest; one where that is near a pole."""
    high = metres / DEGREE_M
    outer = F.greatest(F.abs(band * high), F.abs((band + 1) * high)) + high
    spans = F.degrees(F.asin(F.lit(math.sin(min(metres / EARTH_M, math.pi / 2))) / F.cos(F.radians(outer)))) * 1.001
    return F.when(outer + high < 89.9, F.greatest(F.lit(1.0), F.floor(360 / spans))).otherwise(1.0).cast("long")


def _band(lat: Column, metres: float) -> Column:
    return F.floor(lat / (metres / DEGREE_M))


def _cell(lon: Column, cells: Column) -> Column:
    return F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) * cells / 360.0), cells - 1)


def in_cells(places: DataFrame, metres: float) -> DataFrame:
    """places(lat, lon, ...) with _cy and _cx, the cell of a grid for reaches of `metres`."""
    return places.withColumn("_cy", _band(F.col("lat"), metres)).withColumn("_cx", _cell(F.col("lon"), _rows_of_cells(F.col("_cy"), metres)))


def within(points: DataFrame, stops: DataFrame, metres: float) -> DataFrame:
    """points(query_id, lat, lon), stops(stop_id, lat, lon, ...) -> query_id, metres and the stop's columns, for all stops within
    reach, at any latitude and across the date line.

    A join on grid cells: bands of latitude as high as the reach, each cut into cells as wide as the reach is there, so a stop
    within reach lies in a point's cell or one beside it. Null coordinates reach nothing."""
    near = points.filter("lat is not null and lon is not null").select("query_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.explode(F.array(*[_band(F.col("lat"), metres) + i for i in (-1, 0, 1)])).alias("_cy"))
    near = near.withColumn("_n", _rows_of_cells(F.col("_cy"), metres)).withColumn("_x", _cell(F.col("_lon"), F.col("_n")))
    near = near.withColumn("_cx", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("_x") + i, F.col("_n")) for i in (-1, 0, 1)])))).drop("_n", "_x")
    rows = near.join(in_cells(stops.filter("lat is not null and lon is not null"), metres), ["_cy", "_cx"])
    rows = rows.withColumn("metres", haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))).filter(F.col("metres") <= metres)
    return rows.drop("_lat", "_lon", "_cy", "_cx")


def by_place(points: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """answer(points), which depends on each point's place alone, found once for each place: points often share one."""
    known = points.filter("lat is not null and lon is not null").select("query_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    places = known.select(F.struct(F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).alias("query_id")).distinct()
    found = answer(places.select("query_id", "query_id.lat", "query_id.lon"))
    rest = [c for c in found.columns if c != "query_id"]
    found = found.select(F.col("query_id.lat").alias("_lat"), F.col("query_id.lon").alias("_lon"), *rest)
    return known.join(found, ["_lat", "_lon"]).select("query_id", *rest)


def first_of_places(stops: DataFrame, k: int, name: str = "stop_id") -> DataFrame:
    """The first k stops, by name, of each place: no others can be among the k nearest of a point."""
    known = stops.filter("lat is not null and lon is not null")
    return top_by(known, ["lat", "lon"], [F.col(name)], k, "_r").drop("_r")


def nearest_within(points: DataFrame, stops: DataFrame, k: int, metres: float, name: str = "stop_id") -> DataFrame:
    """The k nearest stops of each point within reach, with rank, as within() gives them; ties, to the millimetre, go to the smaller
    name. Found once for each place that points share, among the first k stops of each place; of the stops' places first those
    are found that are needed to have k stops."""
    few, at = first_of_places(stops, k, name), F.round("metres", 3)
    spots = few.groupBy("lat", "lon").agg(F.count("*").alias("n"))

    def answer(places: DataFrame) -> DataFrame:
        one = Window.partitionBy("query_id")
        held = F.sum("n").over(one.orderBy(at, "lat", "lon").rowsBetween(Window.unboundedPreceding, 0))
        rows = within(places, spots, metres).withColumn("_held", held)
        rows = rows.withColumn("_last", F.min(F.when(F.col("_held") >= k, at)).over(one)).filter(F.col("_last").isNull() | (at <= F.col("_last")))
        return top_by(rows.drop("n", "_held", "_last").join(few, ["lat", "lon"]), ["query_id"], [at, F.col(name)], k)

    return by_place(points, answer)


def nearest(points: DataFrame, stops: DataFrame, k: int = 1, metres: float | None = None, start: float = 500.0) -> DataFrame:
    """The k nearest stops of each point, however far (or within metres): query_id, rank (from 1), metres and the stop's columns.
    Ties, to the millimetre, go to the smaller stop_id. A point with null coordinates has none; fewer than k stops are all given.

    Points with k stops within `start` are done by one join. The others go down a hierarchy of cubes round the globe, each with
    8 x 8 x 8 smaller ones: where poles and the date line are does not matter there. At each level, adding up stops of the
    cubes at hand by farthest possible distance gives one within which k stops lie for certain, and only cubes that may hold a
    nearer stop are opened. So a point far from all stops meets some hundreds of cubes, not a city's stops one by one, and the
    number of jobs does not depend on how far it is. Points are dealt out once; what they open stays in their task as long as a
    level can be broadcast."""
    if k <= 0 or (metres is not None and metres <= 0):
        raise ValueError("k and metres must be above 0")
    order = [F.round("metres", 3), F.col("stop_id")]
    if metres is not None:
        return nearest_within(points, stops, k, metres)
    with passing(points.sparkSession) as made:
        near = nearest_within(points, stops, k, start)
        near = kept(cut(near.withColumn("_k", F.count("*").over(Window.partitionBy("query_id"))).filter(F.col("_k") == k).drop("_k"), "near"), made)
        rest = cut(points.filter("lat is not null and lon is not null").select("query_id", "lat", "lon").join(near.select("query_id"), "query_id", "left_anti"), "near-points")
        opened, held = _opened(rest, first_of_places(stops, k), k, start / 8)
        far = join_counted(opened, held, "cube", "inner")
        far = far.withColumn("metres", haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
        far = kept(cut(top_by(far, ["query_id"], order, k).select(*near.columns), "near"), made)
    return near.unionByName(far)


def _cubes(places: DataFrame, side: float) -> DataFrame:
    """places with x, y, z (metres from the globe's corner) and cube, the numbers of its three edges."""
    la, lo = F.radians("lat"), F.radians("lon")
    at = {"x": F.cos(la) * F.cos(lo), "y": F.cos(la) * F.sin(lo), "z": F.sin(la)}
    rows = places.withColumns({c: v * EARTH_M + (EARTH_M + 1) for c, v in at.items()})
    return rows.withColumn("cube", F.array(*[F.floor(F.col(c) / side) for c in at]))


def _opened(points: DataFrame, stops: DataFrame, k: int, side: float) -> tuple[DataFrame, DataFrame]:
    """The cubes of `side` that may hold one of a point's k nearest stops (query_id, _lat, _lon, cube), and the stops with their cubes."""
    held = cut(_cubes(stops.filter("lat is not null and lon is not null"), side).drop("x", "y", "z"), "near-stops")
    levels = [cut(held.groupBy("cube").agg(F.count("*").alias("n")), "near-cubes")]
    while side < 2 * EARTH_M + 2:
        parent = F.transform("cube", lambda i: F.floor(i / 8))
        levels[-1] = cut(levels[-1].withColumn("parent", parent), "near-cubes")
        levels.append(cut(levels[-1].groupBy(F.col("parent").alias("cube")).agg(F.sum("n").alias("n")), "near-cubes"))
        side *= 8
    own = ["query_id", "_lat", "_lon", "x", "y", "z"]
    at = _cubes(points, side).withColumnsRenamed({"lat": "_lat", "lon": "_lon"}).select(*own)
    at = at.repartition(max(1, points.count() // POINTS), "query_id")
    opened = at.withColumns({"sure": F.lit(1e12), "cube": F.array(*[F.lit(0).cast("long")] * 3)})
    total = held.count()
    for level in reversed(levels[:-1]):
        side /= 8
        rows = join_counted(opened.withColumnRenamed("cube", "parent"), level, "parent", "inner")
        middle = [(F.get("cube", F.lit(i)) + 0.5) * side - F.col(c) for i, c in enumerate("xyz")]
        rows = rows.withColumn("_d", F.sqrt(sum((m * m for m in middle), F.lit(0.0))))
        reach = side * math.sqrt(3) / 2 + SLACK
        by = Window.partitionBy("query_id")
        rows = rows.withColumn("_held", F.sum("n").over(by.orderBy("_d", "cube").rowsBetween(Window.unboundedPreceding, 0)))
        enough = F.min(F.when(F.col("_held") >= min(k, total), F.col("_d") + reach)).over(by)
        rows = rows.withColumn("sure", F.least("sure", enough)).filter(F.col("_d") - reach <= F.col("sure"))
        opened = rows.select(*own, "sure", "cube")
        if level._rows > BROADCAST_ROWS:
            opened = cut(opened, "near-opened")
    return opened.select("query_id", "_lat", "_lon", "cube"), held


def near_stops(points: DataFrame, stops: DataFrame, k: int = 24, metres: float = 500, speed: float = 0.7) -> DataFrame:
    """stops(stop_id, canonical, lat, lon) -> query_id, stop_id, stop (station), metres, seconds: the k nearest stops within reach."""
    some = nearest_within(points, stops, k, metres).withColumn("metres", F.round("metres", 3))
    return some.select("query_id", "stop_id", F.col("canonical").alias("stop"), "metres", walk_seconds(F.col("metres"), F.lit(speed)).alias("seconds"))


def candidates(points: DataFrame, stops: DataFrame, k: int = 6, metres: float = 500, speed: float = 0.7) -> DataFrame:
    """stops(stop_id, canonical, lat, lon) -> query_id, stop (station), metres, seconds, rank: of the 4 k nearest stops the nearest
    one of each station, k of them."""

    def answer(places: DataFrame) -> DataFrame:
        best = near_stops(places, stops, 4 * k, metres, speed).groupBy("query_id", "stop").agg(F.min("metres").alias("metres"))
        first = top_by(best, ["query_id"], [F.col("metres"), F.col("stop")], k)
        return first.withColumn("seconds", walk_seconds(F.col("metres"), F.lit(speed)))

    return by_place(points, answer)
