"""Map layers: network lines, population grid, floor-space grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import laea_to_wgs84, short_distance, utm32_to_wgs84
from ..functions.lines import MAX_GAP_M, family, family_rank, hex_colour, line_colour, line_offset, rapid
from ..functions.times import blank_to_null


def line_shapes(routes: DataFrame, trips: DataFrame) -> DataFrame:
    """Trips of each rapid-transit (line, shape) with the line's family and the feed's colour: line, family, shape_id, own, n."""
    rows = trips.join(routes, "route_id").filter(rapid(F.col("route_short_name"), F.col("shape_id")))
    counts = rows.groupBy("route_short_name", "route_color", "shape_id").agg(F.count("trip_id").alias("c"))
    line = F.upper(F.trim("route_short_name"))
    counts = counts.select(line.alias("line"), family(F.col("route_short_name")).alias("family"), "shape_id", hex_colour(F.col("route_color")).alias("own"), "c")
    return counts.filter("family is not null").groupBy("line", "family", "shape_id").agg(F.min("own").alias("own"), F.max("c").alias("n"))


def frequent_shapes(shapes: DataFrame) -> DataFrame:
    """Of s_bahn lines only shapes with max(5, a tenth of the line's most) trips or more, unless none would be left."""
    w = Window.partitionBy("line", "family")
    least = F.greatest(F.lit(5), F.rint(F.max("n").over(w) * 0.1))
    rows = shapes.withColumn("_ok", (F.col("family") != "s_bahn") | (F.col("n") >= least))
    return rows.withColumn("_any", F.max(F.col("_ok").cast("int")).over(w)).filter("_ok or _any = 0").drop("_ok", "_any")


def shape_pieces(points: DataFrame, refs: DataFrame) -> DataFrame:
    """points(shape_id, shape_pt_sequence, lat, lon) of the shapes in refs, cut at interior gaps of s_bahn lines: line,
    shape_id, piece, coords (array of [lon, lat]). Pieces of one point are dropped."""
    rows = points.dropDuplicates(["shape_id", "shape_pt_sequence"]).join(refs.select("line", "family", "shape_id"), "shape_id")
    w = Window.partitionBy("line", "shape_id").orderBy("shape_pt_sequence")
    i, n = F.row_number().over(w), F.count("*").over(Window.partitionBy("line", "shape_id"))
    gap = short_distance(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    cut = (F.col("family") == "s_bahn") & (i > 2) & (i < n) & (gap > MAX_GAP_M)
    rows = rows.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("piece", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.array_sort(F.collect_list(F.struct("shape_pt_sequence", "lon", "lat")))
    out = rows.groupBy("line", "shape_id", "piece").agg(F.transform(item, lambda p: F.array(p["lon"], p["lat"])).alias("coords"))
    return out.filter(F.size("coords") >= 2)


def network_lines(routes: DataFrame, trips: DataFrame, points: DataFrame) -> DataFrame:
    """One feature for each line: line, family, colour, line_offset, n_pieces, geometry (GeoJSON), rank in drawing order."""
    refs = frequent_shapes(line_shapes(routes, trips))
    pieces = shape_pieces(points, refs).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("shape_id", "piece", "coords"))).alias("p"))
    lines = refs.groupBy("line", "family").agg(F.min_by("own", F.when(F.col("own").isNotNull(), F.col("shape_id"))).alias("own"), F.sum("n").alias("trips"))
    rows = lines.join(pieces, "line").withColumn("coords", F.transform("p", lambda x: x["coords"]))
    one = F.to_json(F.struct(F.lit("LineString").alias("type"), F.get("coords", 0).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.col("coords").alias("coordinates")))
    rows = rows.select("line", "family", line_colour(F.col("line"), F.col("family"), F.col("own")).alias("colour"), line_offset(F.col("line"), F.col("family")).alias("line_offset"), F.size("coords").alias("n_pieces"), F.when(F.size("coords") == 1, one).otherwise(many).alias("geometry"), "trips")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(family_rank(F.col("family")), "line")))


def population_estimate(raw: Column) -> Column:
    """A cell's number of people: the number given, the middle of a masked [0-3], else null."""
    text = blank_to_null(raw)
    return F.coalesce(text.try_cast("double"), F.when(text == "[0-3]", 1.5))


def cell_corner(grid_id: Column) -> tuple[Column, Column]:
    """Northing and easting of a grid id's end, N<digits>E<digits>; null without one."""
    part = lambda i: F.regexp_extract(grid_id, r"N(\d+)E(\d+)$", i).try_cast("long")
    return part(1), part(2)


def storeys_of(storeys: Column, height: Column, storey_height: float = 3.2) -> Column:
    """Storeys as given, else height over storey_height, else 1; 1 at least."""
    return F.greatest(F.lit(1.0), F.coalesce(F.when(storeys > 0, storeys.cast("double")), F.rint(height / storey_height), F.lit(1.0)))


def snapped(metres: Column, resolution: int) -> Column:
    """The edge of the grid cell that a coordinate lies in."""
    return (F.floor(metres / resolution) * resolution).cast("int")


def one_of_each(cells: DataFrame, order: str) -> DataFrame:
    """One row for each grid_id, the first by `order`, with n, the number of its rows."""
    rest = [c for c in cells.columns if c not in ("grid_id", order)]
    first = cells.groupBy("grid_id").agg(F.min_by(F.struct(*rest), order).alias("_f"), F.count("*").alias("n"))
    return first.select("grid_id", *[F.col(f"_f.{c}").alias(c) for c in rest], "n")


def population_cells(cells: DataFrame, year: int, bounds: tuple[float, float, float, float] | None = None, merged: bool = False) -> DataFrame:
    """Cells of a year with a positive estimate: grid_id, lat, lon (centre), estimate, ring. '[0-3]' is estimated as 1.5.

    bounds: min_lat, min_lon, max_lat, max_lon of the centre, inclusive. merged: rows of one grid_id are one cell, with the first
    one's estimate in the table's order and n, the number of rows; else each is a cell."""
    est = population_estimate(F.col("population_raw"))
    n, e = (c.cast("double") for c in cell_corner(F.col("grid_id")))
    rows = cells.filter(F.col("dataset_year") == year).select("grid_id", est.alias("estimate"), n.alias("_n"), e.alias("_e")).filter("estimate > 0 and _n is not null")
    if merged:
        rows = one_of_each(rows.withColumn("_at", F.monotonically_increasing_id()), "_at")
    lat, lon = laea_to_wgs84(F.col("_e") + 500, F.col("_n") + 500)
    rows = rows.withColumn("lat", lat).withColumn("lon", lon)
    if bounds:
        if bounds[0] > bounds[2] or bounds[1] > bounds[3]:
            raise ValueError("a lower bound is above its upper one")
        rows = rows.filter(F.col("lat").between(bounds[0], bounds[2]) & F.col("lon").between(bounds[1], bounds[3]))
    corners = []
    for dx, dy in ((0, 0), (1000, 0), (1000, 1000), (0, 1000), (0, 0)):
        a, b = laea_to_wgs84(F.col("_e") + dx, F.col("_n") + dy)
        corners.append(F.array(F.round(b, 6), F.round(a, 6)))
    return rows.select("grid_id", "lat", "lon", "estimate", F.array(*corners).alias("ring"), *(["n"] if merged else []))


def floor_space_grid(buildings: DataFrame, release: str, resolution: int = 100, population: float = 1_850_000, storey_height: float = 3.2) -> DataFrame:
    """Cells of a release: easting, northing, n, footprint, floor_space, density, people, people_density, lat, lon.

    Buildings are rectangles w by d at x, y. A building's storeys are those given, else height over storey_height, else 1.
    People are shared out by floor space; cells without floor space are dropped after the totals are taken."""
    if min(resolution, population, storey_height) <= 0:
        raise ValueError("resolution, population and storey height must be above 0")
    area = F.col("w") * F.col("d") * 1.0
    storeys = storeys_of(F.col("storeys"), F.col("height"), storey_height)
    snap = lambda c: snapped(c, resolution)
    rows = buildings.filter(F.col("release") == release).select(snap(F.col("x") + F.col("w") / 2).alias("easting"), snap(F.col("y") + F.col("d") / 2).alias("northing"), area.alias("a"), (area * storeys).alias("f"))
    cells = rows.groupBy("easting", "northing").agg(F.count("*").alias("n"), F.sum("a").alias("footprint"), F.sum("f").alias("floor_space"))
    total = cells.agg(F.coalesce(F.sum("floor_space"), F.lit(0.0)).alias("_t"))
    rows = cells.crossJoin(F.broadcast(total)).filter("floor_space > 0")
    cell = float(resolution * resolution)
    people = F.when(F.col("_t") > 0, population * F.col("floor_space") / F.col("_t")).otherwise(0.0)
    lat, lon = utm32_to_wgs84(F.col("easting") + resolution / 2, F.col("northing") + resolution / 2)
    return rows.select("easting", "northing", "n", "footprint", "floor_space", (F.col("floor_space") * 1e6 / cell).alias("density"), people.alias("people"), (people * 1e6 / cell).alias("people_density"), lat.alias("lat"), lon.alias("lon"))
