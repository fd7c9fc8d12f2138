"""Distance joins by grid cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_pairs(points: DataFrame, radius: float) -> DataFrame:
    """points(id, x, y) -> (a, b, square) for all ordered pairs with 0 < distance <= radius.

    Points are hashed into cells of side radius; one side is copied to its nine neighbouring cells, so the join is on cells."""
    cell = points.withColumn("cx", F.floor(F.col("x") / radius)).withColumn("cy", F.floor(F.col("y") / radius))
    near = cell.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy")
    for c in ("cx", "cy"):
        near = near.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    pairs = near.join(cell.select(F.col("id").alias("b"), "x", "y", "cx", "cy"), ["cx", "cy"])
    square = (F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay"))
    return pairs.filter(F.col("a") != F.col("b")).select("a", "b", square.alias("square")).filter((F.col("square") > 0) & (F.col("square") <= radius * radius))


def nearest_pairs(points: DataFrame, radius: float, k: int, near: Callable[[Column], Column], more: DataFrame | None = None) -> DataFrame:
    """points(id, x, y) -> (a, b, near) for the k others nearest to each point with 0 < distance <= radius, by near(square), then
    id. more(id, more): how many above k some points ask for.

    Found once for each place: points that share one have the same others. Of a place first the places are found that hold
    enough points, and then as many points of each as it asks for."""
    xy, two = ["x", "y"], lambda side: [F.col(c).alias(f"{side}{c}") for c in ("x", "y")]
    ask = points.withColumn("ask", F.lit(k)) if more is None else points.join(more, "id", "left").withColumn("ask", F.lit(k) + F.coalesce("more", F.lit(0)))
    places = ask.groupBy(*xy).agg(F.count("*").alias("n"), F.max("ask").alias("ask"))
    named = F.struct(*xy)
    pairs = grid_pairs(places.select(named.alias("id"), *xy), radius).select(F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), near(F.col("square")).alias("near"))
    pairs = pairs.join(places.select(*two("b"), "n"), ["bx", "by"]).join(places.select(*two("a"), "ask"), ["ax", "ay"])
    one = Window.partitionBy("ax", "ay")
    held = F.sum("n").over(one.orderBy("near", "bx", "by").rowsBetween(Window.unboundedPreceding, 0))
    pairs = pairs.withColumn("_held", held).withColumn("_last", F.min(F.when(F.col("_held") >= F.col("ask"), F.col("near"))).over(one)).filter("_last is null or near <= _last")
    ranked = points.select(F.col("id").alias("b"), *two("b"), F.row_number().over(Window.partitionBy(*xy).orderBy("id")).alias("_r"))
    rows = pairs.join(ranked, ["bx", "by"]).filter("_r <= ask").withColumn("_at", F.row_number().over(one.orderBy("near", "b"))).filter("_at <= ask")
    rows = rows.select("ax", "ay", "b", "near", "_at")
    return ask.select(F.col("id").alias("a"), *two("a"), "ask").join(rows, ["ax", "ay"]).filter("_at <= ask").select("a", "b", "near")
