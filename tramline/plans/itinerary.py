"""Path segments to legs, texts and geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import hex_colour
from ..functions.times import duration_text

#: What legs are drawn in whose line has no colour of its own, or that of the leg before.
LEG_COLOURS = ("#1B6CA8", "#D1495B", "#2F9E44", "#8E5BA6")


def merged_transfers(segments: DataFrame) -> DataFrame:
    """segments(path, pos, kind, label, weight, apply_penalty, from_stop, to_stop) with runs of transfers as one.

    A run's weight is the sum, null if any part is unknown; its label is a walk's, if there is one, else the first; the
    penalty holds if it does for any part. Station links of no time are left out beforehand."""
    rows = segments.filter("not (kind = 'station_link' and coalesce(weight, 0) = 0)")
    w = Window.partitionBy("path").orderBy("pos")
    change = F.col("kind") != "trip"
    new = ~(change & F.coalesce(F.lag(change).over(w), F.lit(False)))
    rows = rows.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c, by: F.min_by(c, by)
    out = rows.groupBy("path", "_run").agg(
        F.min("pos").alias("pos"),
        F.when(F.max((F.col("kind") == "trip").cast("int")) == 1, "trip").otherwise("transfer").alias("kind"),
        F.coalesce(first("label", F.when(F.col("label") == "walk", F.col("pos"))), first("label", F.when(F.col("label").isNotNull(), F.col("pos")))).alias("label"),
        F.when(F.count("weight") == F.count("*"), F.sum("weight")).alias("weight"),
        F.max("apply_penalty").alias("apply_penalty"),
        first("from_stop", "pos").alias("from_stop"),
        F.max_by("to_stop", "pos").alias("to_stop"),
    )
    return out.drop("_run")


def legs(merged: DataFrame, penalty: int = 0) -> DataFrame:
    """Consecutive rides of one label as one leg; transfers part them. path, leg, mode, label, seconds, from_stop, to_stop, text."""
    w = Window.partitionBy("path").orderBy("pos")
    ride = F.col("kind") == "trip"
    same = ride & F.lag(ride).over(w) & F.lag("label").over(w).eqNullSafe(F.col("label"))
    rows = merged.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int"))
    rows = rows.withColumn("leg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cost = F.col("weight") + F.when(F.col("apply_penalty"), penalty).otherwise(0)
    rows = rows.withColumn("_s", F.when(ride, F.col("weight")).otherwise(cost))
    out = rows.groupBy("path", "leg").agg(
        F.min_by("kind", "pos").alias("kind"), F.min_by("label", "pos").alias("label"), F.when(F.count("_s") == F.count("*"), F.sum("_s")).alias("seconds"), F.min_by("from_stop", "pos").alias("from_stop"), F.max_by("to_stop", "pos").alias("to_stop")
    )
    mode = F.when(F.col("kind") == "trip", "ride").when(F.col("label") == "walk", "walk").otherwise("transfer")
    time = F.when(F.col("seconds").isNull(), "unknown time").otherwise(duration_text(F.col("seconds")))
    return out.select("path", "leg", mode.alias("mode"), "label", "seconds", "from_stop", "to_stop", F.concat(F.col("from_stop"), F.lit(" -> "), F.col("to_stop"), F.lit(": "), time).alias("text"))


def nearest_vertex(shape: Column, lat: Column, lon: Column) -> Column:
    """Place of the first vertex nearest to a position, in squared degrees. shape: array<struct<lat, lon, dist>>."""
    square = F.transform(shape, lambda p, i: F.struct((F.pow(p["lat"] - lat, 2) + F.pow(p["lon"] - lon, 2)).alias("d"), i.alias("i")))
    return F.array_min(square)["i"]


def vertex_at(shape: Column, dist: Column) -> Column:
    """Place of the first vertex whose travelled distance is nearest to dist; vertices without one are passed over."""
    known = F.filter(F.transform(shape, lambda p, i: F.struct(F.abs(p["dist"] - dist).alias("d"), i.alias("i"))), lambda x: x["d"].isNotNull())
    return F.array_min(known)["i"]


def shape_slice(shape: Column, a: Column, b: Column) -> Column:
    """Vertices from place a to b: two at least, and reversed if b comes first."""
    low, high = F.least(a, b), F.greatest(a, b)
    high2 = F.when(low == high, F.least(high + 1, F.size(shape) - 1)).otherwise(high)
    low2 = F.when(low == high2, F.greatest(low - 1, F.lit(0))).otherwise(low)
    part = F.slice(shape, low2 + 1, high2 - low2 + 1)
    return F.when(a > b, F.reverse(part)).otherwise(part)


def self_loop(lat: Column, lon: Column, radius: float = 36.0) -> Column:
    """A closed ring of six points around a stop, for a transfer within it."""
    dy, dx = radius / 111_320.0, F.lit(radius / 111_320.0) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))
    turn = [2 * math.pi * i / 5 for i in range(6)]
    return F.array(*[F.array(F.round(lon + dx * math.cos(t), 6), F.round(lat + dy * math.sin(t), 6)) for t in turn])


def fallback_geometry(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """A straight line, or a loop if both ends are one place; null without coordinates."""
    some = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    line = F.array(F.array(lon1, lat1), F.array(lon2, lat2))
    return F.when(some, F.when((lat1 == lat2) & (lon1 == lon2), self_loop(lat1, lon1)).otherwise(line))


def described(steps: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """journeys() or hops() steps with line (a ride's route name, else its id), colour (the route's, if it is one), shape_id, and the
    names of both stops, null where unknown."""
    ride = trips.select("trip_id", "route_id", "shape_id").join(routes.select("route_id", "route_short_name", "route_color"), "route_id", "left")
    ride = ride.select("trip_id", "shape_id", F.coalesce("route_short_name", "route_id").alias("line"), hex_colour(F.col("route_color")).alias("colour"))
    name = lambda side: stops.select(F.col("stop_id").alias(f"{side}_stop"), F.col("stop_name").alias(f"{side}_name"))
    return steps.join(ride, "trip_id", "left").join(name("from"), "from_stop", "left").join(name("to"), "to_stop", "left")


def with_geometry(steps: DataFrame, shapes: DataFrame, coords: DataFrame) -> DataFrame:
    """described() steps with line_string, an array of (lon, lat): a ride's part of its shape between the vertices nearest to its
    stops, cut once for each shape and pair of stops; else, and for walks, the straight line."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("shape_pt_sequence", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    lists = shapes.groupBy("shape_id").agg(points.alias("shape"))
    at = lambda side, n: coords.select(F.col("stop").alias(f"{side}_stop"), F.col("lat").alias(f"lat{n}"), F.col("lon").alias(f"lon{n}"))
    pair = steps.filter("shape_id is not null").select("shape_id", "from_stop", "to_stop").distinct().join(at("from", 1), "from_stop").join(at("to", 2), "to_stop").join(lists, "shape_id")
    part = shape_slice(F.col("shape"), nearest_vertex(F.col("shape"), F.col("lat1"), F.col("lon1")), nearest_vertex(F.col("shape"), F.col("lat2"), F.col("lon2")))
    cut_out = pair.select("shape_id", "from_stop", "to_stop", F.when(F.size("shape") >= 2, F.transform(part, lambda p: F.array(p["lon"], p["lat"]))).alias("_part"))
    rows = steps.join(cut_out, ["shape_id", "from_stop", "to_stop"], "left").join(at("from", 1), "from_stop", "left").join(at("to", 2), "to_stop", "left")
    straight = fallback_geometry(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return rows.withColumn("line_string", F.coalesce("_part", straight)).drop("_part", "lat1", "lon1", "lat2", "lon2")


def leg_colours(own: Column) -> Column:
    """Colours of a journey's rides, given their own ones in order: a ride has its own, unless the one before is drawn in that;
    without one, the palette's next, or the one after that if it is the one before."""
    palette, n = F.array(*map(F.lit, LEG_COLOURS)), len(LEG_COLOURS)
    pick = lambda i, prev: F.when(F.get(palette, i % n) != prev, F.get(palette, i % n)).otherwise(F.get(palette, (i + 1) % n))
    start = F.struct(F.lit("").alias("prev"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        chosen = F.when(c.isNotNull() & (c != a["prev"]), c).otherwise(pick(F.size(a["out"]), a["prev"]))
        return F.struct(chosen.alias("prev"), F.concat(a["out"], F.array(chosen)).alias("out"))

    return F.aggregate(own, start, step)["out"]


def stitched(steps: DataFrame, options: DataFrame, starts: DataFrame, ends: DataFrame, origin: str = "__origin__", destination: str = "__destination__") -> DataFrame:
    """journeys() steps with the walks from and to the requests' coordinates: starts(query_id, stop, seconds), ends(query_id, stop,
    egress). Walks of no time are left out. An option without steps walks from its one stop to its end.

    The first stop of an option is where its first step begins; of an option without steps, the stop of the least walk."""
    key = ["query_id", "round"]
    bounds = steps.groupBy(*key).agg(F.min_by("from_stop", "pos").alias("first"), F.max_by("to_stop", "pos").alias("last"), F.count("*").alias("n"), F.max("arr").alias("_arr"), F.min("dep").alias("_dep"), F.min_by("dep", "pos").alias("_go"))
    bare = options.join(bounds, key, "left_anti").join(starts, "query_id").join(ends, ["query_id", "stop"])
    bare = bare.groupBy(*key).agg(F.min(F.struct((F.col("seconds") + F.col("egress")).alias("s"), "stop")).alias("b"), F.first("arrival").alias("_arr")).select(*key, F.col("b.stop").alias("first"), F.col("b.stop").alias("last"), F.lit(0).cast("long").alias("n"), "_arr")
    both = bounds.select(*key, "first", "last", "n").unionByName(bare.select(*key, "first", "last", "n")).join(options.select(*key, "arrival"), key)
    null = {c: F.lit(None).cast(t).alias(c) for c, t in steps.dtypes if c not in (*key, "pos", "kind", "label", "from_stop", "to_stop", "dep", "arr", "seconds")}
    walk = lambda df, pos, a, b, dep, arr, sec: df.filter(sec > 0).select(*key, pos.cast("int").alias("pos"), F.lit("transfer").alias("kind"), F.lit("walk").alias("label"), a.alias("from_stop"), b.alias("to_stop"), dep.cast("int").alias("dep"), arr.cast("int").alias("arr"), sec.cast("int").alias("seconds"), *null.values())
    out = both.join(starts.select("query_id", F.col("stop").alias("first"), "seconds", "depart"), ["query_id", "first"])
    access = walk(out, F.lit(-1), F.lit(origin), F.col("first"), F.col("depart"), F.col("depart") + F.col("seconds"), F.col("seconds"))
    off = both.join(ends.select("query_id", F.col("stop").alias("last"), "egress"), ["query_id", "last"])
    egress = walk(off, F.col("n"), F.col("last"), F.lit(destination), F.col("arrival") - F.col("egress"), F.col("arrival"), F.col("egress"))
    rows = steps.withColumn("pos", F.col("pos").cast("int")).unionByName(access.select(*steps.columns)).unionByName(egress.select(*steps.columns))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy("pos")) - 1)


def chosen_candidates(steps: DataFrame, options: DataFrame, origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """Which candidate each option begins and ends with: query_id, round, from_stop_id, to_stop_id, access, egress (seconds of the walks).

    steps: journeys() without the walks from and to coordinates; origins, destinations(query_id, stop_id, stop (station),
    seconds): candidates, of which a station may have several. The candidate is the nearest one of the station where the
    option's first step begins (its last one ends); for an option without steps, or whose station has none, the nearest of
    all. Ties go to the smaller stop_id."""
    key = ["query_id", "round"]
    bounds = steps.groupBy(*key).agg(F.min_by("from_stop", "pos").alias("first"), F.max_by("to_stop", "pos").alias("last"))
    rows = options.select(*key).join(bounds, key, "left")
    nearest = F.min(F.struct("seconds", "stop_id"))
    for side, of, place in (("from", origins, "first"), ("to", destinations, "last")):
        own = of.groupBy("query_id", F.col("stop").alias(place)).agg(nearest.alias(f"_{side}"))
        rows = rows.join(own, ["query_id", place], "left").join(of.groupBy("query_id").agg(nearest.alias(f"_any_{side}")), "query_id", "left")
    best = lambda side: F.coalesce(f"_{side}", f"_any_{side}")
    return rows.select(*key, best("from")["stop_id"].alias("from_stop_id"), best("to")["stop_id"].alias("to_stop_id"), best("from")["seconds"].alias("access"), best("to")["seconds"].alias("egress"))


def without_terminals(steps: DataFrame, origin: str = "__origin__", destination: str = "__destination__") -> DataFrame:
    """Steps between stops alone."""
    rows = steps.filter((F.col("from_stop") != origin) & (F.col("to_stop") != destination))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id", "round").orderBy("pos")) - 1)


def answers(steps: DataFrame, options: DataFrame, penalty: int = 0) -> DataFrame:
    """described() steps as one row for each option, as a client shows them: query_id, place (from 0: latest arrival first, then
    transfers, then legs), best (whether it is the one to choose: arrival, transfers, round), round, arrival, transfers, fewest
    (transfers of any option of the request), n_rides, legs (array of leg texts), colours (of the rides)."""
    key = ["query_id", "round"]
    path = F.concat_ws("/", *key)
    segments = steps.select(path.alias("path"), "pos", "kind", F.coalesce("label", F.when(F.col("kind") == "trip", F.col("line"))).alias("label"), F.col("seconds").alias("weight"), (F.col("kind") != "trip").alias("apply_penalty"), "from_stop", "to_stop")
    texts = legs(merged_transfers(segments), penalty).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("leg", "text"))), lambda x: x["text"]).alias("legs"))
    # An array keeps its nulls only inside structs.
    own = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "trip", F.struct("pos", "colour")))), lambda x: x["colour"])
    rides = steps.groupBy(*key).agg(own.alias("own"), F.count(F.when(F.col("kind") == "trip", 1)).cast("int").alias("n_rides"))
    rows = options.join(rides, key, "left").withColumn("path", path).join(texts, "path", "left")
    none = F.array().cast("array<string>")
    rows = rows.select(*key, "arrival", "transfers", F.coalesce("n_rides", F.lit(0)).alias("n_rides"), F.coalesce("legs", none).alias("legs"), F.coalesce(leg_colours(F.col("own")), none).alias("colours"))
    by = Window.partitionBy("query_id")
    shown = by.orderBy(F.desc("arrival"), "transfers", F.size("legs"), "round")
    best = by.orderBy("arrival", "transfers", "round")
    return rows.select("query_id", (F.row_number().over(shown) - 1).alias("place"), (F.row_number().over(best) == 1).alias("best"), "round", "arrival", "transfers", F.min("transfers").over(by).alias("fewest"), "n_rides", "legs", "colours")
