"""Edge tables of the search graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M
from ..operators.ordered import first_by, row_numbers, top_by
from ..operators.spatial import nearest_pairs
from ..shared import cut
from .timetable import canonical_stops


#: What a hub's name begins with, and what parts stop and pattern in a node's.
HUB, PART = "hub of ", "::"


def walk_edges(coords: DataFrame, max_metres: float = 500, speed: float = 1.4, max_neighbours: int = 8, existing: DataFrame | None = None) -> DataFrame:
    """coords(stop, lat, lon) -> from_stop, to_stop, metres, seconds for the nearest neighbours within max_metres.

    Positions are projected about the mean latitude; pairs in `existing` (from_stop, to_stop) are left out before the cap,
    which counts per source, so the result need not be symmetric: as many more neighbours are looked for as a stop has such pairs. Limits of 0 or less give no edge; speed must be above 0."""
    if speed <= 0:
        raise ValueError("speed must be above 0")
    spark = coords.sparkSession
    if max_metres <= 0 or max_neighbours <= 0:
        return spark.createDataFrame([], "from_stop string, to_stop string, metres int, seconds int")
    mean = coords.agg(F.avg("lat").alias("_m"))
    shrink = F.greatest(F.cos(F.radians("_m")), F.lit(1e-8))
    xy = coords.crossJoin(F.broadcast(mean)).select(F.col("stop").alias("id"), (F.radians("lon") * EARTH_M * shrink).alias("x"), (F.radians("lat") * EARTH_M).alias("y"))
    left_out = None if existing is None else existing.select("from_stop", "to_stop").distinct()
    more = None if existing is None else left_out.groupBy(F.col("from_stop").alias("id")).agg(F.count("*").alias("more"))
    pairs = nearest_pairs(xy, float(max_metres), max_neighbours, lambda square: F.rint(F.sqrt(square)).cast("int"), more)
    pairs = pairs.select(F.col("a").alias("from_stop"), F.col("b").alias("to_stop"), F.col("near").alias("metres"))
    if existing is not None:
        pairs = pairs.join(left_out, ["from_stop", "to_stop"], "left_anti")
    kept = top_by(pairs, ["from_stop"], [F.col("metres"), F.col("to_stop")], max_neighbours, "_r").drop("_r")
    return kept.withColumn("seconds", F.greatest(F.lit(1), F.rint(F.col("metres") / speed).cast("int")))


def symmetric(transfers: DataFrame) -> DataFrame:
    """Transfers in both directions."""
    rest = [c for c in transfers.columns if c not in ("from_stop_id", "to_stop_id")]
    back = transfers.select(F.col("to_stop_id").alias("from_stop_id"), F.col("from_stop_id").alias("to_stop_id"), *rest)
    return transfers.unionByName(back)


def canonical_transfers(transfers: DataFrame, stops: DataFrame) -> DataFrame:
    """from_stop, to_stop, weight between canonical stops; loops are left out."""
    c = canonical_stops(stops)
    f = c.select(F.col("stop_id").alias("from_stop_id"), F.col("canonical").alias("f"))
    t = c.select(F.col("stop_id").alias("to_stop_id"), F.col("canonical").alias("t"))
    rows = transfers.join(f, "from_stop_id", "left").join(t, "to_stop_id", "left")
    rows = rows.select(F.coalesce("f", "from_stop_id").alias("from_stop"), F.coalesce("t", "to_stop_id").alias("to_stop"), F.col("min_transfer_time").alias("weight"))
    return rows.filter("from_stop <> to_stop")


def preferred(edges: DataFrame, walk: Column, weight: Column) -> DataFrame:
    """One edge for each pair: not a walk before a walk, then the smaller weight (unknown counts as 10**9)."""
    return first_by(edges, ["from_stop", "to_stop"], [walk.cast("int"), F.coalesce(weight, F.lit(10**9)), weight.isNull()])


def footpaths(transfers: DataFrame, walks: DataFrame) -> DataFrame:
    """Preferred footpaths: explicit transfers (unknown time: 0) before walks. from_stop, to_stop, seconds, is_walk."""
    explicit = transfers.select("from_stop", "to_stop", F.greatest(F.lit(0), F.coalesce("weight", F.lit(0))).cast("int").alias("seconds"), F.lit(False).alias("is_walk"))
    walked = walks.select("from_stop", "to_stop", "seconds", F.lit(True).alias("is_walk"))
    return preferred(explicit.unionByName(walked).filter("from_stop <> to_stop"), F.col("is_walk"), F.col("seconds"))


def multi_edges(pairs: DataFrame, trips: DataFrame, transfers: DataFrame, walks: DataFrame, stops: DataFrame) -> DataFrame:
    """All edges between stations: kind (trip, transfer, walk, station_link), from_stop, to_stop, weight, dep, arr, trip_id."""
    null = lambda t: F.lit(None).cast(t)
    trip = pairs.join(trips.select("trip_id"), "trip_id", "left_semi").select(F.lit("trip").alias("kind"), "from_stop", "to_stop", "weight", "dep", "arr", "trip_id")
    plain = lambda df, kind, weight: df.select(F.lit(kind).alias("kind"), "from_stop", "to_stop", weight.cast("int").alias("weight"), null("int").alias("dep"), null("int").alias("arr"), null("string").alias("trip_id"))
    links = canonical_stops(stops).filter("stop_id <> canonical").select(F.col("stop_id").alias("from_stop"), F.col("canonical").alias("to_stop"))
    both = links.unionByName(links.select(F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop")))
    return trip.unionByName(plain(transfers, "transfer", F.col("weight"))).unionByName(plain(walks, "walk", F.col("seconds"))).unionByName(plain(both, "station_link", F.lit(0)))


def pattern_nodes(patterns: DataFrame) -> DataFrame:
    """stop, pattern, node: where patterns call."""
    rows = patterns.select("pattern", F.explode("stops").alias("stop")).distinct()
    return rows.select("stop", "pattern", F.concat_ws(PART, "stop", "pattern").alias("node"))


def hub_edges(nodes: DataFrame, paths: DataFrame, penalty: int = 0) -> DataFrame:
    """Changes between pattern nodes by way of a hub for each stop, so n nodes meet m by n + m edges: from_node, to_node,
    weight. A stop of two nodes or more has its own hub at no cost but the penalty; paths lead from a stop's nodes to the
    hub of the other stop. The preferred edge of each pair stays."""
    nodes, hub = cut(nodes, "nodes"), F.concat(F.lit(HUB), "stop")
    many = nodes.groupBy("stop").count().filter("count >= 2").select("stop")
    reached = paths.select(F.col("to_stop").alias("stop")).union(many).distinct()
    at = nodes.join(reached, "stop", "left_semi")
    out = at.select(hub.alias("from_stop"), F.col("node").alias("to_stop"), F.lit(0).alias("weight"), F.lit(False).alias("walk"))
    own = nodes.join(many, "stop", "left_semi").select(F.col("node").alias("from_stop"), hub.alias("to_stop"), F.lit(penalty).alias("weight"), F.lit(False).alias("walk"))
    there = F.concat(F.lit(HUB), "to_stop")
    goes = nodes.join(paths.select(F.col("from_stop").alias("stop"), "to_stop", "seconds", "is_walk"), "stop")
    goes = goes.join(nodes.select(F.col("stop").alias("to_stop")).distinct(), "to_stop", "left_semi")
    goes = goes.select(F.col("node").alias("from_stop"), there.alias("to_stop"), (F.col("seconds") + F.when(F.col("is_walk"), 0).otherwise(penalty)).alias("weight"), F.col("is_walk").alias("walk"))
    best = preferred(own.unionByName(goes).unionByName(out), F.col("walk"), F.col("weight"))
    return best.select(F.col("from_stop").alias("from_node"), F.col("to_stop").alias("to_node"), "weight")


def anytime_edges(pairs: DataFrame, trips: DataFrame, medians: DataFrame, headway: DataFrame, default_headway: int | None = 900) -> DataFrame:
    """Rides without clock times between (stop, trip) nodes: weight is the segment's median, else the ride's own; headway is
    the route's, else the default."""
    keys = ["route_id", "service_id", "direction_id"]
    rows = pairs.join(trips.select("trip_id", *keys), "trip_id", "left")
    same = lambda other, on: [rows[k].eqNullSafe(other[k]) for k in on]
    m, h = medians.drop("n"), headway.drop("n")
    out = rows.join(m, same(m, [*keys, "from_stop", "to_stop"]), "left").select(rows["*"], "median_sec")
    out = out.join(h, [out[k].eqNullSafe(h[k]) for k in keys], "left").select(out["*"], "headway_sec")
    return out.select("trip_id", "from_stop", "to_stop", F.coalesce("median_sec", "weight").alias("weight"), F.coalesce("headway_sec", F.lit(default_headway)).alias("headway"))


def dense_ids(values: DataFrame, col: str) -> DataFrame:
    """Dictionary codes from 1 in the values' order; 0 is kept for null."""
    return row_numbers(values.select(col).filter(F.col(col).isNotNull()).distinct(), col, "code")


def nodes_of(stops: DataFrame, nodes: DataFrame) -> DataFrame:
    """stop, nodes: a stop's pattern nodes in order, or the stop itself where no pattern calls."""
    own = nodes.groupBy("stop").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    return stops.select("stop").distinct().join(own, "stop", "left").select("stop", F.coalesce("nodes", F.array("stop")).alias("nodes"))


def base_stop(node: Column) -> Column:
    """The stop of a node or hub: without a hub's name and a pattern's part."""
    bare = F.when(node.startswith(HUB), F.substring(node, len(HUB) + 1, 1 << 20)).otherwise(node)
    return F.regexp_replace(bare, f"{PART}pattern_[^:]*$", "")


def node_parts(node: Column) -> tuple[Column, Column]:
    """Stop and pattern of a pattern node, parted at the first mark; an error if it has none."""
    at = F.instr(node, PART)
    ok = F.when(at > 0, node).otherwise(F.raise_error(F.concat(F.lit("not a pattern node: "), node)).cast("string"))
    return F.substring_index(ok, PART, 1), F.substring(ok, at + len(PART), F.char_length(ok))


def pattern_rides(pairs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Consecutive stops as rides between pattern nodes: from_node, to_node, dep, arr, trip_id; none that arrives before it leaves."""
    rows = pairs.filter("weight is not null").join(patterns.select("trip_id", "pattern"), "trip_id")
    return rows.select(F.concat_ws(PART, "from_stop", "pattern").alias("from_node"), F.concat_ws(PART, "to_stop", "pattern").alias("to_node"), "dep", "arr", "trip_id")


def node_transfers(moves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Explicit transfers between all nodes of their two stops (see hub_edges() for the form that does not multiply)."""
    side = lambda s: nodes.select(F.col("stop").alias(f"{s}_stop"), F.col("node").alias(f"{s}_node"))
    return moves.join(side("from"), "from_stop").join(side("to"), "to_stop").select("from_node", "to_node", "weight")


def preferred_anytime(rides: DataFrame, transfers: DataFrame, walks: DataFrame) -> DataFrame:
    """One edge for each pair of stops: kind, weight, headway. A ride before others, a transfer before a walk, then the smaller
    weight plus half the headway."""
    none = F.lit(None).cast("int").alias("headway")
    ride = rides.select("from_stop", "to_stop", F.lit("ride").alias("kind"), "weight", "headway")
    move = transfers.select("from_stop", "to_stop", F.lit("transfer").alias("kind"), "weight", none)
    walk = walks.select("from_stop", "to_stop", F.lit("walk").alias("kind"), F.col("seconds").alias("weight"), none)
    cost = F.coalesce(F.col("weight") + F.floor(F.coalesce("headway", F.lit(0)) / 2), F.lit(10**9))
    order = [F.when(F.col("kind") == "ride", 0).when(F.col("kind") == "transfer", 1).otherwise(2), cost, F.coalesce("weight", F.lit(10**9))]
    return first_by(ride.unionByName(move).unionByName(walk), ["from_stop", "to_stop"], order)


def compact(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges by dictionary codes instead of names, and the dictionary (stop, code)."""
    names = edges.select(F.col("from_stop").alias("stop")).union(edges.select("to_stop"))
    codes = cut(dense_ids(names, "stop"), "codes")
    side = lambda s: codes.select(F.col("stop").alias(f"{s}_stop"), F.col("code").alias(s))
    out = edges.join(side("from"), "from_stop").join(side("to"), "to_stop").drop("from_stop", "to_stop")
    return out, codes


def inserted(rides: DataFrame, transfers: DataFrame) -> DataFrame:
    """The edge kept of each pair of stops: timed (departures that do not arrive before they leave), untimed (the least weight of
    rides without times), transfer (the preferred one): kind, from_stop, to_stop, n, weight."""
    timed = rides.filter("dep is not null and arr >= dep").groupBy("from_stop", "to_stop").agg(F.count("*").alias("n"), F.min(F.col("arr") - F.col("dep")).alias("weight")).withColumn("kind", F.lit("timed"))
    untimed = rides.filter("dep is null or arr is null").groupBy("from_stop", "to_stop").agg(F.count("*").alias("n"), F.min("weight").alias("weight")).withColumn("kind", F.lit("untimed"))
    moves = preferred(transfers.select("from_stop", "to_stop", "weight"), F.lit(False), F.col("weight")).withColumns({"n": F.lit(1).cast("long"), "kind": F.lit("transfer")})
    return timed.unionByName(untimed).unionByName(moves)


def synthetic(edges: DataFrame, kind: str, label: str | None = None, apply_penalty: bool = False) -> DataFrame:
    """Copies of edges as another kind, with another label, and with the penalty only if asked for."""
    return edges.withColumns({"kind": F.lit(kind), "label": F.lit(label).cast("string"), "apply_penalty": F.lit(apply_penalty)})


def search_edges(rides: DataFrame, trips: DataFrame, transfers: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """Rides (trip_id, from_stop, to_stop, weight, and headway or dep and arr, as far as they have them), transfers and walks as
    the edges that search.edge_labels() takes. Penalties apply to transfers, not to walks."""
    kinds = {"weight": "int", "headway": "int", "dep": "int", "arr": "int", "trip_id": "string", "route_id": "string", "apply_penalty": "boolean"}

    def edges(df: DataFrame, kind: Column) -> DataFrame:
        return df.select("from_stop", "to_stop", kind.alias("kind"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    ridden = rides.drop("route_id").join(trips.select("trip_id", "route_id"), "trip_id", "left")
    timed = F.lit("ride") if "dep" not in rides.columns else F.when(F.col("dep").isNotNull() & F.col("arr").isNotNull(), "trip").otherwise("ride")
    out = edges(ridden, timed).unionByName(edges(transfers.withColumn("apply_penalty", F.lit(True)), F.lit("transfer")))
    return out if walks is None else out.unionByName(edges(walks.withColumns({"weight": F.col("seconds"), "apply_penalty": F.lit(False)}), F.lit("walk")))


def adjacency(stops: DataFrame, pairs: DataFrame, transfers: DataFrame) -> DataFrame:
    """stop, rides, buckets (stops that they go to) and moves that leave each stop; 0 where there are none."""
    rides = pairs.filter("weight is not null").groupBy(F.col("from_stop").alias("stop")).agg(F.count("*").alias("rides"), F.countDistinct("to_stop").alias("buckets"))
    moves = transfers.groupBy(F.col("from_stop").alias("stop")).agg(F.count("*").alias("moves"))
    return stops.select("stop").distinct().join(rides, "stop", "left").join(moves, "stop", "left").fillna(0, ["rides", "buckets", "moves"])


def graph_counts(edges: DataFrame) -> DataFrame:
    """One row: nodes and edges of an edge table (from_stop, to_stop, kind)."""
    ends = edges.select(F.col("from_stop").alias("n")).union(edges.select("to_stop"))
    kinds = edges.groupBy("kind").count()
    return ends.agg(F.countDistinct("n").alias("nodes")).crossJoin(kinds.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("edges"), F.count("*").alias("kinds")))


def first_children(stops: DataFrame, paths: DataFrame) -> DataFrame:
    """station, nearest, seconds: of each station's stops the one that paths from the station reach first; ties by stop_id."""
    rows = stops.filter("parent_station <> ''").select("stop_id", F.col("parent_station").alias("from_stop")).join(paths, "from_stop")
    rows = rows.groupBy("from_stop").agg(F.min(F.struct("seconds", "stop_id")).alias("b"))
    return rows.select(F.col("from_stop").alias("station"), F.col("b.stop_id").alias("nearest"), F.col("b.seconds").alias("seconds"))
