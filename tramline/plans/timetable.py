"""Stops, patterns, departures and timetables derived from a feed's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import first_time, time_to_seconds
from ..shared import cut, join_counted, kept, passing, rows_of

#: Trips of a pattern that are compared in order at a time, and rows of such blocks that a task gets, about.
BLOCK_TRIPS, BLOCK_ROWS = 10_000, 100_000


def canonical_stops(stops: DataFrame) -> DataFrame:
    """stop_id, canonical: the parent station, or the stop itself if it has none."""
    return stops.filter("stop_id is not null").select("stop_id", F.coalesce(F.nullif(F.col("parent_station"), F.lit("")), "stop_id").alias("canonical"))


def canonical_coordinates(stops: DataFrame) -> DataFrame:
    """canonical, lat, lon of the first of its stops (by id) with both coordinates."""
    located = stops.join(canonical_stops(stops), "stop_id").filter("stop_lat is not null and stop_lon is not null")
    first = F.min(F.struct("stop_id", "stop_lat", "stop_lon")).alias("f")
    return located.groupBy("canonical").agg(first).select("canonical", F.col("f.stop_lat").alias("lat"), F.col("f.stop_lon").alias("lon"))


def bounds(stops: DataFrame) -> DataFrame:
    """One row: west, south, east, north of the stops' coordinates, and n, the number of different stops."""
    return stops.agg(F.min("stop_lon").alias("west"), F.min("stop_lat").alias("south"), F.max("stop_lon").alias("east"), F.max("stop_lat").alias("north"), F.countDistinct("stop_id").alias("n"))


def timed_stops(stop_times: DataFrame, stops: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows with both ids: trip_id, seq, stop (canonical), arr, dep (seconds, each standing in for the other if empty). tasks: how
    many they are dealt to by trip, which windows and joins by trip then keep."""
    rows = stop_times.filter("trip_id is not null and trip_id <> '' and stop_id is not null and stop_id <> ''")
    rows = join_counted(rows, canonical_stops(stops), "stop_id")
    arr, dep = time_to_seconds(first_time(F.col("arrival_time"), F.col("departure_time"))), time_to_seconds(first_time(F.col("departure_time"), F.col("arrival_time")))
    rows = rows.select("trip_id", F.col("stop_sequence").alias("seq"), F.coalesce("canonical", "stop_id").alias("stop"), arr.alias("arr"), dep.alias("dep"))
    return rows if tasks is None else rows.repartition(tasks, "trip_id")


def consecutive(timed: DataFrame) -> DataFrame:
    """Pairs of following stops of a trip: trip_id, from_stop, to_stop, dep, arr, weight (null if arr < dep or unknown)."""
    w = Window.partitionBy("trip_id").orderBy(F.col("seq").asc_nulls_last())
    rows = timed.select("trip_id", F.lag("stop").over(w).alias("from_stop"), F.col("stop").alias("to_stop"), F.lag("dep").over(w).alias("dep"), "arr", F.col("seq"))
    rows = rows.filter("from_stop is not null and from_stop <> to_stop")
    return rows.withColumn("weight", F.when(F.col("arr") >= F.col("dep"), F.col("arr") - F.col("dep"))).drop("seq")


def departures(pairs: DataFrame, trips: DataFrame) -> DataFrame:
    """Departure buckets: from_stop, to_stop, list of (dep, trip_id, arr, route_id) by departure, last_dep. Overtaken by
    their own departure (arr < dep) rows are left out."""
    rows = pairs.filter("weight is not null").join(trips.select("trip_id", "route_id"), "trip_id", "left")
    item = F.struct("dep", "trip_id", "arr", "route_id")
    return rows.groupBy("from_stop", "to_stop").agg(F.array_sort(F.collect_list(item)).alias("rides"), F.max("dep").alias("last_dep"))


def merged_stops(timed: DataFrame) -> DataFrame:
    """Runs of the same stop in a trip as one row: earliest arrival, latest departure; pos counts from 0."""
    w = Window.partitionBy("trip_id").orderBy(F.col("seq").asc_nulls_last())
    run = timed.withColumn("_new", F.coalesce(F.lag("stop").over(w) != F.col("stop"), F.lit(True)).cast("int"))
    run = run.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = run.groupBy("trip_id", "_run").agg(F.first("stop").alias("stop"), F.min("arr").alias("arr"), F.max("dep").alias("dep"), F.max((F.col("arr").isNull() | F.col("dep").isNull()).cast("int")).alias("_bad"))
    return rows.select("trip_id", (F.col("_run") - 1).cast("int").alias("pos"), "stop", "arr", "dep", "_bad")


def valid_trips(merged: DataFrame) -> DataFrame:
    """merged_stops() of trips without unknown times, with two stops or more, and with times that never run backwards."""
    trip = Window.partitionBy("trip_id")
    bad = (F.col("_bad") == 1) | (F.col("dep") < F.col("arr")) | (F.col("arr") < F.lag("dep").over(trip.orderBy("pos")))
    rows = merged.filter("trip_id is not null").withColumn("_b", F.coalesce(bad, F.lit(False)).cast("int"))
    rows = rows.withColumns({"_b": F.max("_b").over(trip), "_n": F.count("*").over(trip)})
    return rows.filter("_b = 0 and _n >= 2").drop("_b", "_n", "_bad")


def _patterned(valid: DataFrame, trips: DataFrame) -> DataFrame:
    """trip_id, pattern, _digest, stops, route_id, direction_id, first_dep, last_arr of each trip."""
    item = F.array_sort(F.collect_list(F.struct("pos", "stop")))
    seqs = valid.groupBy("trip_id").agg(F.transform(item, lambda x: x["stop"]).alias("stops"), F.min_by("dep", "pos").alias("first_dep"), F.max_by("arr", "pos").alias("last_arr"))
    rows = seqs.join(trips.select("trip_id", "route_id", "direction_id"), "trip_id", "left")
    text = F.concat(F.coalesce("route_id", F.lit("")), F.lit("|"), F.coalesce(F.col("direction_id").cast("string"), F.lit("")), F.lit("|"), F.array_join("stops", ","))
    return rows.withColumn("_digest", F.md5(text)).withColumn("pattern", F.concat(F.lit("pattern_"), F.substring("_digest", 1, 12)))


def _one_digest(low: Column, high: Column) -> Column:
    return F.when(low == high, F.col("pattern")).otherwise(F.raise_error(F.concat(F.lit("two patterns are called "), "pattern")).cast("string"))


def patterns_alone(valid: DataFrame, trips: DataFrame) -> DataFrame:
    """pattern, stops: one row for each of trip_patterns()'s patterns, by partial aggregates, so no task has all trips of one."""
    rows = _patterned(valid, trips).groupBy("pattern").agg(F.min("_digest").alias("_a"), F.max("_digest").alias("_b"), F.min("stops").alias("stops"))
    return rows.select(_one_digest(F.col("_a"), F.col("_b")).alias("pattern"), "stops")


def patterns_of_trips(valid: DataFrame, trips: DataFrame) -> DataFrame:
    """trip_id, pattern as in trip_patterns(), without an order of the trips, so no task has all trips of a pattern."""
    rows = cut(_patterned(valid, trips).select("trip_id", "pattern", "_digest"), "trip-patterns")
    known = rows.groupBy("pattern").agg(F.min("_digest").alias("_a"), F.max("_digest").alias("_b"))
    known = cut(known.select(_one_digest(F.col("_a"), F.col("_b")).alias("pattern")), "patterns")
    return join_counted(rows, known, "pattern", "inner").select("trip_id", "pattern")


def trip_patterns(valid: DataFrame, trips: DataFrame) -> DataFrame:
    """trip_id, pattern, trip_index: trips of one route, direction and stop list share a pattern, in order of first
    departure, last arrival and id. The pattern's id is the beginning of a digest of the three; two patterns of one id are an
    error."""
    rows = _patterned(valid, trips)
    all_, w = Window.partitionBy("pattern"), Window.partitionBy("pattern").orderBy("first_dep", "last_arr", "trip_id")
    known = _one_digest(F.min("_digest").over(all_), F.max("_digest").over(all_))
    return rows.select("trip_id", known.alias("pattern"), (F.row_number().over(w) - 1).alias("trip_index"), "route_id", "direction_id", "stops")


def _fallen_behind(calls: DataFrame) -> DataFrame:
    """calls, a written table, with _late: whether the trip at some place leaves or arrives before one that comes before it in its
    pattern's order. The order is cut into blocks; of all blocks before it a block gets one row for each place, so no task has
    all trips of a pattern."""
    block = [*calls.columns, F.floor(F.col("trip_index") / BLOCK_TRIPS).alias("_block")]
    place = ["pattern", "_block", "pos"]
    ahead = Window.partitionBy("pattern", "pos").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    most = calls.select(*block).groupBy(*place).agg(F.max("arr").alias("_a"), F.max("dep").alias("_d"))
    most = cut(most.select(*place, F.max("_a").over(ahead).alias("_arr"), F.max("_d").over(ahead).alias("_dep")), "chain-blocks")
    # Dealt by block, which the windows below keep.
    rows = calls.select(*block).repartition(1 + rows_of(calls) // BLOCK_ROWS, "pattern", "_block")
    before = Window.partitionBy(*place).orderBy("trip_index").rowsBetween(Window.unboundedPreceding, -1)
    late = (F.col("arr") < F.greatest("_arr", F.max("arr").over(before))) | (F.col("dep") < F.greatest("_dep", F.max("dep").over(before)))
    rows = join_counted(rows, most, place, "inner").withColumn("_late", F.coalesce(late, F.lit(False)))
    return rows.select(*calls.columns, F.bool_or("_late").over(Window.partitionBy("pattern", "_block", "trip_id")).alias("_late"))


def overtaken(calls: DataFrame) -> DataFrame:
    """trip_id of the trips that at some place of their pattern leave or arrive before a trip that comes before them in the pattern's
    order. calls(pattern, trip_id, trip_index, pos, arr, dep), a written table."""
    return _fallen_behind(calls).filter("_late").select("trip_id").distinct()


def trip_chains(calls: DataFrame, max_chains: int = 1000) -> DataFrame:
    """calls with `chain`, from 0: within a chain of a pattern no trip overtakes another, so the first one to leave a place is also
    the first at every later place.

    The first chain is what never falls behind any trip before it; what is left makes the next chain the same way. A round
    deals the trips that are left out once, and there are as many as trips overtake one another in a row."""
    with passing(calls.sparkSession) as made:
        calls, done, n = cut(calls, "chain-calls"), [], 0
        while True:
            told = kept(cut(_fallen_behind(calls), "chain"), made)
            done.append(told.filter("not _late").drop("_late").withColumn("chain", F.lit(n)))
            calls = told.filter("_late").drop("_late")
            if rows_of(calls) == 0:
                return reduce(DataFrame.unionByName, done)
            n += 1
            if n == max_chains:
                raise ValueError(f"trips of a pattern overtake one another in more than {max_chains} chains")


def segment_medians(pairs: DataFrame, trips: DataFrame) -> DataFrame:
    """Median run time of each (route, service, direction, from, to); of two middle values their mean rounded down."""
    rows = pairs.filter("weight is not null").join(trips.select("trip_id", "route_id", "service_id", "direction_id"), "trip_id", "left")
    return rows.groupBy("route_id", "service_id", "direction_id", "from_stop", "to_stop").agg(F.floor(F.median("weight")).cast("int").alias("median_sec"), F.count("*").alias("n"))


def headways(timed: DataFrame, trips: DataFrame) -> DataFrame:
    """Median of the positive gaps between the first departures of a (route, service, direction); null without any. A trip whose
    first stop has no known time counts from the first one that has."""
    place = F.when(F.col("dep").isNotNull(), F.struct(F.col("seq").isNull(), "seq"))
    first = timed.groupBy("trip_id").agg(F.min_by("dep", place).alias("dep")).filter("dep is not null")
    rows = first.join(trips.select("trip_id", "route_id", "service_id", "direction_id"), "trip_id", "left")
    keys = ["route_id", "service_id", "direction_id"]
    gap = F.col("dep") - F.lag("dep").over(Window.partitionBy(*keys).orderBy("dep", "trip_id"))
    rows = rows.withColumn("gap", gap).withColumn("gap", F.when(F.col("gap") > 0, F.col("gap")))
    return rows.groupBy(*keys).agg(F.floor(F.median("gap")).cast("int").alias("headway_sec"), F.count("*").alias("n"))
