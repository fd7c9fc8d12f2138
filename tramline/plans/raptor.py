"""Round-based earliest-arrival search over all queries at once, and the journeys it found."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut, drop, join_counted, kept, passing
from .timetable import overtaken, trip_chains

#: What an equal arrival is decided by, in this order: a ride before a walk, then the smaller trip, place and stop.
PARENT = ["is_walk", "trip_id", "from_pos", "from_stop", "pos", "dep", "seconds", "foot"]


class Found(NamedTuple):
    """options(query_id, round, arrival, transfers): one row for each round that arrives earlier than all before it. labels: what
    each round improved, with the step that led there: query_id, round, stop, grp, t, and PARENT; a row without a stop holds for
    all stops of its group. starts(query_id, stop, seconds, depart) and ends(query_id, stop, egress): the ways to the first stops
    and from the last ones. groups: still_groups(), if the search was given them."""

    options: DataFrame
    labels: DataFrame
    ends: DataFrame
    starts: DataFrame
    groups: DataFrame | None = None


def boardings(calls: DataFrame, width: int) -> DataFrame:
    """calls -> (grp, stop, bin, pattern, from_pos, deps): sorted departures of a pattern's place in a bin of width seconds and the
    next one, so whoever is ready in a bin finds what leaves within width in one row. Of trips that leave at one time only the
    first is in it, so a row has no more departures than seconds."""
    at, place = F.floor(F.col("dep") / width), ["grp", "stop", "pattern", F.col("pos").alias("from_pos")]
    rows = calls.groupBy("grp", "stop", "pattern", "pos", "dep").agg(F.min(F.struct("trip_index", "trip_id")).alias("f"))
    rows = rows.select(*place, F.struct("dep", "f.trip_index", "f.trip_id").alias("d"), F.explode(F.array(at, at - 1)).alias("bin"))
    return rows.groupBy("grp", "stop", "bin", "pattern", "from_pos").agg(F.array_sort(F.collect_list("d")).alias("deps"))


def grouped(df: DataFrame, groups: DataFrame | None) -> DataFrame:
    """df(stop, ...) with grp: the stop's group, or the stop itself if it has none."""
    if groups is None:
        return df.withColumn("grp", F.col("stop"))
    return join_counted(df, groups, "stop").withColumn("grp", F.coalesce("grp", "stop"))


def still_groups(paths: DataFrame, max_rounds: int = 10) -> DataFrame:
    """stop, grp of stops that footpaths lead round in no time, each to each: whoever is at one is at all of them, so a search needs
    one label for them all, and their walks need not be closed. A group is named by its smallest stop; other stops are left out.

    Each stop picks one of its footpaths of no time (explicit transfers alone); following them, twice as far each step, finds the
    rings that they make. Rings become one stop each, footpaths to where none go on are left out, and then it begins anew, until
    there are none, max_rounds times at most: what is not found is walked as any other footpath."""
    with passing(paths.sparkSession) as made:
        still = paths.filter("seconds = 0 and from_stop <> to_stop")
        still = still.filter("not is_walk") if "is_walk" in paths.columns else still.limit(0)
        ways, groups = cut(still.select("from_stop", "to_stop").distinct(), "still-ways"), None
        for _ in range(max_rounds):
            ring = cut(_rings(ways), "still-rings")
            if groups is None:
                groups = ring
            elif not ring.isEmpty():
                of = join_counted(groups, ring.select(F.col("stop").alias("grp"), F.col("grp").alias("_g")), "grp").select("stop", F.coalesce("_g", "grp").alias("grp"))
                groups = cut(of.unionByName(ring.join(groups.select("stop"), "stop", "left_anti")), "still-groups")
            left = group_paths(ways.withColumn("seconds", F.lit(0)), ring).select("from_stop", "to_stop")
            ways = cut(left.join(left.select(F.col("from_stop").alias("to_stop")).distinct(), "to_stop", "left_semi"), "still-ways")
            if ways.isEmpty():
                break
        return kept(groups, made)


def _rings(ways: DataFrame) -> DataFrame:
    """stop, grp (its smallest stop) of the rings that the ways to the smallest stop of each make."""
    at = cut(ways.groupBy(F.col("from_stop").alias("stop")).agg(F.min("to_stop").alias("next")).withColumn("grp", F.col("stop")), "still-next")
    for _ in range(at.count().bit_length()):
        on = at.select(F.col("stop").alias("next"), F.col("next").alias("_next"), F.col("grp").alias("_g"))
        at = cut(at.join(on, "next").select("stop", F.col("_next").alias("next"), F.least("grp", "_g").alias("grp")), "still-next")
    return at.join(at.select(F.col("next").alias("stop")).distinct(), "stop", "left_semi").select("stop", "grp")


def group_paths(paths: DataFrame, groups: DataFrame) -> DataFrame:
    """The least footpath between each two groups, in paths' columns but with groups for stops."""
    for side in ("from_stop", "to_stop"):
        rest = [c for c in paths.columns if c != side]
        paths = grouped(paths.withColumnRenamed(side, "stop"), groups).select(*rest, F.col("grp").alias(side))
    cost = [c for c in ("seconds", "is_walk") if c in paths.columns]
    return paths.filter("from_stop <> to_stop").groupBy("from_stop", "to_stop").agg(F.min(F.struct(*cost)).alias("w")).select("from_stop", "to_stop", "w.*")


def between_groups(valid: DataFrame, groups: DataFrame) -> DataFrame:
    """valid_trips() that lead from one group to another; within a group one is everywhere before any of its trips leaves."""
    trip = Window.partitionBy("trip_id")
    rows = grouped(valid, groups).withColumn("_leads", F.min("grp").over(trip) < F.max("grp").over(trip))
    return rows.filter("_leads").select(*valid.columns)


def search(queries: DataFrame, sources: DataFrame, targets: DataFrame, valid: DataFrame, patterns: DataFrame, paths: DataFrame, max_rounds: int = 8, horizon: int = 14_400, max_wait: int | None = 1_200, penalty: int = 0, closed: bool = False, groups: DataFrame | None = None) -> Found:
    """Options of each query and the labels that lead to them.

    queries(query_id, depart), sources(query_id, stop, seconds), targets(query_id, stop, seconds); valid: valid_trips();
    patterns: trip_patterns(); paths(from_stop, to_stop, seconds, is_walk; without is_walk all are walks).

    A round boards from the stops that the round before has improved: the first trip of each pattern to leave that stop
    within max_wait of the ready time (arrival there, plus the penalty after the first boarding) and the horizon. All later
    stops of those trips are reached; strict improvements are kept, then footpaths are walked to a fixpoint (one step does if
    they are closed, see station_walks()). Labels that are no earlier than the target has been reached lead to no option and
    are left out. Trips of one pattern that overtake each other are parted into chains that do not (see trip_chains()), each boarded
    as a pattern of its own, so the least arrival over all trips is found.

    groups: still_groups() of the footpaths; `paths` are then those between groups (group_paths()), and valid may be without trips
    that lead nowhere (between_groups()). A group has one label for all its stops. With closed walks the steps to each of its
    stops are kept as if it had its own: by a ride that arrives there, else by a walk from where a ride arrives; without closed
    walks only the options can be had.

    Everything is keyed by query and stop, so a batch of queries is one job a round. Boarding is an equi-join on the stop and
    the ready time's bin of max_wait seconds, so a busy station's day is not joined with each query. Labels are written tables,
    so lineage stays short and lost executors cost a reread."""
    spark = queries.sparkSession
    with passing(spark) as made:
        return _search(made, queries, sources, targets, valid, patterns, paths, max_rounds, horizon, max_wait, penalty, closed, groups)


def _search(made, queries, sources, targets, valid, patterns, paths, max_rounds, horizon, max_wait, penalty, closed, groups) -> Found:
    keep = lambda df, name: kept(cut(df, name), made)
    width = max_wait or horizon
    limit = cut(queries.select("query_id", (F.col("depart") + horizon).alias("limit")), "search-limits")
    calls = cut(valid.join(patterns.select("trip_id", "pattern", "trip_index"), "trip_id").select("pattern", "trip_id", "trip_index", "pos", "stop", "arr", "dep"), "search-calls")
    if not overtaken(calls).isEmpty():
        chain = F.when(F.col("chain") == 0, F.col("pattern")).otherwise(F.concat_ws("#", "pattern", "chain"))
        calls = cut(trip_chains(calls).withColumn("pattern", chain).drop("chain"), "search-calls")
    calls = cut(grouped(calls, groups), "search-calls")
    board = cut(boardings(calls, width), "search-boardings")
    foot = F.col("is_walk") if "is_walk" in paths.columns else F.lit(True)
    paths = cut(paths.select(F.col("from_stop").alias("_grp"), F.col("to_stop").alias("grp"), F.col("seconds").cast("int").alias("seconds"), foot.alias("foot")), "search-paths")
    ends = keep(grouped(targets.groupBy("query_id", "stop").agg(F.min("seconds").alias("egress")), groups), "search-ends")
    starts = keep(sources.groupBy("query_id", "stop").agg(F.min("seconds").alias("seconds")).join(queries, "query_id"), "search-starts")

    none = {"is_walk": "int", "trip_id": "string", "from_pos": "int", "from_stop": "string", "pos": "int", "dep": "int", "seconds": "int", "foot": "boolean"}
    parent = lambda **given: [given.get(c, F.lit(None)).cast(t).alias(c) for c, t in none.items()]

    def improved(best: DataFrame | None, bound: DataFrame | None, new: DataFrame) -> DataFrame:
        """The best new label of each query and stop, if within the horizon, earlier than the target so far and than the best, and
        no later than its group's others. What the first two rule out is dropped before anything is shuffled."""
        new = join_counted(new, limit, "query_id", "inner").filter("t <= limit").drop("limit")
        if bound is not None:
            new = join_counted(new, bound, "query_id").filter("bound is null or t < bound").drop("bound")
        new = least(new)
        if best is not None:
            new = new.join(best.withColumnRenamed("t", "_old"), ["query_id", "grp"], "left").filter("_old is null or t < _old").drop("_old")
        return new if groups is None else first_of_groups(new)

    def least(labels: DataFrame) -> DataFrame:
        return labels.groupBy("query_id", "grp", "stop").agg(F.min(F.struct("t", *PARENT)).alias("l")).select("query_id", "grp", "stop", "l.*")

    def first_of_groups(labels: DataFrame) -> DataFrame:
        return labels.withColumn("_t", F.min("t").over(Window.partitionBy("query_id", "grp"))).filter("t = _t").drop("_t")

    def merged(best: DataFrame | None, new: DataFrame) -> DataFrame:
        new = new.select("query_id", "grp", "t")
        new = new if best is None else best.unionByName(new)
        return new if best is None and groups is None else new.groupBy("query_id", "grp").agg(F.min("t").alias("t"))

    def walked(best: DataFrame | None, bound: DataFrame | None, rode: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The round's labels after walking on from `rode` until nothing gets earlier, and the best labels then."""
        labels, front, old, best = rode, rode, best, cut(merged(best, rode), "search-best")
        while True:
            at = front.select("query_id", F.col("grp").alias("_grp"), F.coalesce("stop", "grp").alias("from_stop"), "t")
            far = join_counted(at, paths, "_grp", "inner")
            if closed and groups is not None:
                # The group's other stops; they have the label of the way that is first to any of them, also where a ride is as early.
                far, best = far.unionByName(at.withColumns({"grp": F.col("_grp"), "seconds": F.lit(0), "foot": F.lit(False)})), old
            far = far.select("query_id", (F.col("grp") if groups is None else F.lit(None).cast("string")).alias("stop"), "grp", (F.col("t") + F.col("seconds")).alias("t"), *parent(is_walk=F.lit(1), from_stop=F.col("from_stop"), seconds=F.col("seconds"), foot=F.col("foot")))
            front = cut(improved(best, bound, far), "search-walks")
            if front.isEmpty():
                return labels, best
            best = cut(merged(best, front), "search-best")
            labels = least(labels.unionByName(front))
            if closed:
                return labels, best

    def reached(labels: DataFrame, n: int) -> DataFrame:
        got = join_counted(labels.select("query_id", "grp", "t").join(ends, ["query_id", "grp"]), limit, "query_id", "inner").withColumn("a", (F.col("t") + F.col("egress")).cast("int")).filter("a <= limit")
        return got.groupBy("query_id").agg(F.min("a").alias("arrival")).withColumn("round", F.lit(n))

    rode = join_counted(starts, limit, "query_id", "inner").withColumn("t", (F.col("depart") + F.col("seconds")).cast("int")).filter("t <= limit")
    rode = grouped(rode.select("query_id", "stop", "t", *parent(is_walk=F.lit(0))), groups)
    rode = cut(rode if groups is None else first_of_groups(rode), "search-sources")
    best, bound, rounds, arrivals = None, None, [], []
    for n in range(max_rounds + 1):
        if n:
            ready = rounds[-1].select("query_id", "grp", "t") if groups is None else rounds[-1].groupBy("query_id", "grp").agg(F.min("t").alias("t"))
            ready = join_counted(ready.select("query_id", "grp", (F.col("t") + (penalty if n > 1 else 0)).alias("ready")), limit, "query_id", "inner")
            # What was improved later than the target was reached, or leaves later, leads nowhere.
            ready = join_counted(ready, bound, "query_id").withColumn("limit", F.least("limit", F.col("bound") - 1)).filter("ready <= limit").drop("bound")
            on = ready.withColumn("bin", F.floor(F.col("ready") / width)).join(board, ["grp", "bin"])
            last = F.least(F.col("limit"), F.col("ready") + max_wait) if max_wait is not None else F.col("limit")
            on = on.withColumn("d", F.get(F.filter("deps", lambda d: (d["dep"] >= F.col("ready")) & (d["dep"] <= last)), F.lit(0))).filter("d is not null")
            # Of boardings of one trip only the first place counts.
            first = on.groupBy("query_id", F.col("d.trip_id").alias("trip_id")).agg(F.min(F.struct("from_pos", F.col("stop").alias("from_stop"), F.col("d.dep").alias("dep"))).alias("b"))
            ridden = first.select("query_id", "trip_id", "b.*").join(calls.select("trip_id", "pos", "stop", "grp", "arr"), "trip_id").filter("pos > from_pos")
            ridden = ridden.select("query_id", "stop", "grp", F.col("arr").alias("t"), *parent(is_walk=F.lit(0), trip_id=F.col("trip_id"), from_pos=F.col("from_pos"), from_stop=F.col("from_stop"), pos=F.col("pos"), dep=F.col("dep")))
            rode = cut(improved(best, bound, ridden), "search-rides")
            if rode.isEmpty():
                break
        labels, best = walked(best, bound, rode)
        rounds.append(keep(labels.select("query_id", F.lit(n).alias("round"), "stop", "grp", "t", *PARENT), "search-labels"))
        arrivals.append(keep(reached(rounds[-1], n), "search-arrivals"))
        bound = cut(reduce(DataFrame.unionByName, arrivals).groupBy("query_id").agg(F.min("arrival").alias("bound")), "search-bounds")
    earlier = F.min("arrival").over(Window.partitionBy("query_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1))
    options = reduce(DataFrame.unionByName, arrivals).withColumn("_e", earlier).filter("_e is null or arrival < _e")
    options = options.select("query_id", "round", "arrival", F.greatest(F.col("round") - 1, F.lit(0)).alias("transfers"))
    return Found(options, reduce(DataFrame.unionByName, rounds), ends.drop("grp"), starts, groups)


def raptor(*args, **options) -> DataFrame:
    """The options alone of search()."""
    return search(*args, **options).options


def best_options(options: DataFrame) -> DataFrame:
    """The option of each query that arrives first, then has fewest transfers and boardings."""
    first = options.groupBy("query_id").agg(F.min(F.struct("arrival", "transfers", "round")).alias("o"))
    return first.select("query_id", "o.round", "o.arrival", "o.transfers")


def journeys(found: Found, options: DataFrame | None = None) -> DataFrame:
    """The steps of each option (all, or those of `options`): query_id, round, pos (from 0), kind (trip, transfer), label (walk or
    null), from_stop, to_stop, dep, arr, seconds, trip_id, from_pos, to_pos.

    Walks back from the target's label: a walk comes from a label of its own round, a ride from one of the round before. A step
    back is an equi-join for all options at once, so there are at most two for each round."""
    with passing(found.options.sparkSession) as made:
        return _journeys(made, found, found.options if options is None else options)


def _journeys(made, found: Found, options: DataFrame) -> DataFrame:
    labels = found.labels.withColumnRenamed("round", "at")
    least = labels.groupBy("query_id", F.col("at").alias("round"), "grp").agg(F.min("t").alias("t"))
    reach = grouped(options.select("query_id", "round", "arrival").join(found.ends, "query_id"), found.groups)
    at = reach.join(least, ["query_id", "round", "grp"]).filter(F.col("t") + F.col("egress") == F.col("arrival"))
    first = at.groupBy("query_id", "round").agg(F.min(F.struct("egress", "stop")).alias("e"))
    cursor = cut(first.select("query_id", "round", F.col("e.stop").alias("stop"), F.col("round").alias("at")), "journey-cursor")
    steps, n = [], 0
    while not steps or not cursor.isEmpty():
        got = cursor.join(labels.drop("grp"), ["query_id", "stop", "at"])
        if found.groups is not None:
            # A stop's own label, or its group's; if both are as early, the ride.
            own = ["query_id", "round", "stop", "at"]
            of = grouped(cursor, found.groups).join(labels.filter("stop is null").drop("stop"), ["query_id", "grp", "at"])
            got = got.unionByName(of.select(*got.columns)).groupBy(*own).agg(F.min(F.struct("t", *PARENT)).alias("l")).select(*own, "l.*")
        got = got.filter("from_stop is not null").withColumn("back", F.lit(n))
        steps.append(kept(cut(got, "journey-steps"), made))
        cursor = cut(steps[-1].select("query_id", "round", F.col("from_stop").alias("stop"), (F.col("at") - 1 + F.col("is_walk")).alias("at")), "journey-cursor")
        n += 1
    rows = reduce(DataFrame.unionByName, steps)
    pos = F.row_number().over(Window.partitionBy("query_id", "round").orderBy(F.desc("back"))) - 1
    ride = F.col("is_walk") == 0
    return rows.select("query_id", "round", pos.alias("pos"), F.when(ride, "trip").otherwise("transfer").alias("kind"), F.when(~ride & F.col("foot"), "walk").alias("label"), "from_stop", F.col("stop").alias("to_stop"), F.when(ride, F.col("dep")).otherwise(F.col("t") - F.col("seconds")).alias("dep"), F.col("t").alias("arr"), F.when(ride, F.col("t") - F.col("dep")).otherwise(F.col("seconds")).alias("seconds"), "trip_id", "from_pos", F.col("pos").alias("to_pos"))


def station_walks(paths: DataFrame, limit: int | None = None) -> DataFrame:
    """Shortest walks over any number of footpaths, of `limit` seconds at most: from_stop, to_stop, seconds, is_walk (whether any
    part is no explicit transfer; without is_walk all are walks). Each step joins walks with walks, so it ends after the
    logarithm of the longest chain.

    A search whose horizon is the limit loses nothing by it. The walks are still all pairs of stations within it: for feeds of
    many stations within a walk of each other, search() with closed=False walks on from what it has reached instead."""
    least = lambda df: df.groupBy("from_stop", "to_stop").agg(F.min(F.struct("seconds", "is_walk")).alias("w")).select("from_stop", "to_stop", "w.*")
    foot = F.col("is_walk") if "is_walk" in paths.columns else F.lit(True)
    within = F.lit(True) if limit is None else F.col("seconds") <= limit
    best = cut(least(paths.select("from_stop", "to_stop", F.col("seconds").cast("long").alias("seconds"), foot.alias("is_walk")).filter(within)), "walks")
    seen = None
    while seen != (now := best.agg(F.count("*"), F.sum("seconds"), F.sum(F.col("is_walk").cast("int"))).first()):
        seen = now
        on = best.select(F.col("from_stop").alias("to_stop"), F.col("to_stop").alias("end"), F.col("seconds").alias("more"), F.col("is_walk").alias("foot"))
        longer = best.join(on, "to_stop").filter("from_stop <> end").select("from_stop", F.col("end").alias("to_stop"), (F.col("seconds") + F.col("more")).alias("seconds"), (F.col("is_walk") | F.col("foot")).alias("is_walk")).filter(within)
        old, best = best, cut(least(best.unionByName(longer)), "walks")
        drop(old)
    return best

