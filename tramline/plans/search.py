"""Label-correcting earliest arrival over departure buckets and transfers, for all queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..shared import cut, few, importable, join_counted, kept, passing, rows_of, written

#: What an equal arrival is decided by, in this order.
STEP = ["kind", "trip_id", "from_stop", "from_active", "dep"]
#: No vehicle is faster, in metres a second.
MAX_SPEED = 55.0
#: Written tables that are read beside one another before they are put together.
TABLES = 12
#: Labels up to which all of them are broadcast to a step's candidates.
FEW = 200_000
#: Bins of departures in the longest wait.
BINS = 5


def lower_bound(lat: Column, lon: Column, goal_lat: Column, goal_lon: Column, speed: float = MAX_SPEED) -> Column:
    """Seconds that a way to the goal takes at least; 0 where a place is unknown."""
    return F.coalesce(F.ceil(haversine(lat, lon, goal_lat, goal_lon) / speed), F.lit(0)).cast("int")


def departure_bins(rides: DataFrame, width: int) -> DataFrame:
    """rides -> (from_stop, bin, to_stop, deps): sorted departures of a bucket in a bin of width seconds and the next one. Of those that
    leave at one time only the first is in it, as no other is ever taken, so a row has no more departures than seconds."""
    at = F.floor(F.col("dep") / width)
    rows = rides.groupBy("from_stop", "to_stop", "dep").agg(F.min(F.struct("trip_id", "arr", "route_id")).alias("f"))
    rows = rows.select("from_stop", "to_stop", F.struct("dep", "f.trip_id", "f.arr", "f.route_id").alias("d"), F.explode(F.array(at, at - 1)).alias("bin"))
    return rows.groupBy("from_stop", "bin", "to_stop").agg(F.array_sort(F.collect_list("d")).alias("deps"))


def next_bins(rides: DataFrame, keys: list[str], width: int, within: int) -> DataFrame:
    """rides(*keys, dep, d) with one row a departure -> (*keys, bin, deps): by departure, d of those that leave in a bin of width seconds,
    and of the next one after it. So what leaves first from any time of a bin on, within that many seconds, is in one short row."""
    at = lambda c: F.floor(F.col(c) / width)
    last = F.lag("dep").over(Window.partitionBy(*keys).orderBy("dep"))
    rows = rides.withColumn("last", last).withColumn("from", F.greatest(at("last"), F.floor((F.col("dep") - within) / width)))
    rows = rows.select(*keys, "d", F.explode(F.sequence(F.col("from"), at("dep"))).alias("bin"))
    return rows.groupBy(*keys, "bin").agg(F.array_sort(F.collect_list("d")).alias("deps"))


def soonest_bins(rides: DataFrame, width: int) -> DataFrame:
    """rides(from_stop, to_stop, dep, arr, trip_id) -> (from_stop, bin, to_stop, own, next): by departure, the soonest to arrive (arr,
    trip_id, dep) of those that leave in a bin of width seconds from then on, and of those in the next one until then. So what
    arrives first of all that leave within width is found in one row, which has no more entries than seconds."""
    rows = rides.groupBy("from_stop", "to_stop", "dep").agg(F.min(F.struct("arr", "trip_id", "dep")).alias("b")).withColumn("bin", F.floor(F.col("dep") / width))
    w = Window.partitionBy("from_stop", "to_stop", "bin").orderBy("dep")
    on = rows.withColumn("own", F.min("b").over(w.rowsBetween(0, Window.unboundedFollowing))).withColumn("next", F.min("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    entry = lambda c: F.struct("dep", F.col(c).alias("best"))
    both = on.select("from_stop", "to_stop", F.explode(F.array(F.struct("bin", entry("own").alias("own"), F.lit(None).alias("next")), F.struct((F.col("bin") - 1).alias("bin"), F.lit(None).alias("own"), entry("next").alias("next")))).alias("e"))
    return both.groupBy("from_stop", F.col("e.bin").alias("bin"), "to_stop").agg(F.array_sort(F.collect_list("e.own")).alias("own"), F.array_sort(F.collect_list("e.next")).alias("next"))


def labels(queries: DataFrame, rides: DataFrame, transfers: DataFrame, goals: DataFrame | None = None, coords: DataFrame | None = None, horizon: int = 14_400, max_wait: int | None = 1_200, penalty: int = 0, route_penalty: int = 0, max_steps: int = 400) -> DataFrame:
    """All labels that were an improvement when found: query_id, step, stop, active, t, and STEP, the way there from a label of the
    step before.

    queries(query_id, stop, depart); rides(from_stop, to_stop, dep, arr[, trip_id, route_id]); transfers(from_stop, to_stop,
    weight, apply_penalty). A state is a stop and the route one is on, none after a transfer; without a route penalty the route
    does not matter, and a state is a stop. At a stop, of each next stop the first ride that leaves within max_wait and the
    horizon is taken, with the route penalty if one is on another route, or a transfer of known weight plus the penalty if it
    applies. A step relaxes only the labels that the step before improved, and it ends when none improves; max_steps without
    that is an error. The wait limit holds for each label on its own, also where a stop is later found to be reached earlier.
    Rides that arrive before they leave are left out.

    goals(query_id, stop): labels that cannot reach the goal before the best arrival there, by the straight way from coords(stop,
    lat, lon) at MAX_SPEED, are left out, which keeps the goal's labels and the ways there."""
    with passing(queries.sparkSession) as made:
        return _labels(made, queries, rides, transfers, goals, coords, horizon, max_wait, penalty, route_penalty, max_steps)


def _labels(made, queries, rides, transfers, goals, coords, horizon, max_wait, penalty, route_penalty, max_steps) -> DataFrame:
    wait = max_wait if max_wait is not None else horizon
    width = max(1, wait // BINS)
    for c in ("trip_id", "route_id"):
        rides = rides if c in rides.columns else rides.withColumn(c, F.lit(None).cast("string"))
    first = rides.filter("arr >= dep").groupBy("from_stop", "to_stop", "dep").agg(F.min(F.struct("trip_id", "arr", "route_id")).alias("f"))
    first = first.select("from_stop", "to_stop", "dep", F.struct("dep", "f.trip_id", "f.arr", "f.route_id").alias("d"))
    bins = cut(_dealt(next_bins(first, ["from_stop", "to_stop"], width, wait)), "search-rides")
    cost = F.col("weight") + F.when(F.col("apply_penalty"), penalty).otherwise(0)
    moves = cut(transfers.filter("weight is not null").groupBy("from_stop", "to_stop").agg(F.min(cost).alias("cost")), "search-moves")

    def onward(at: DataFrame) -> DataFrame:
        seen = bins.join(few(at.withColumn("bin", F.floor(F.col("t") / width)), at), ["from_stop", "bin"])
        last = F.least(F.col("limit"), F.col("t") + max_wait) if max_wait is not None else F.col("limit")
        seen = seen.withColumn("d", F.get(F.filter("deps", lambda d: (d["dep"] >= F.col("t")) & (d["dep"] <= last)), F.lit(0))).filter("d is not null")
        change = F.when(F.col("from_active").isNotNull() & ~F.col("from_active").eqNullSafe(F.col("d.route_id")), route_penalty).otherwise(0)
        on = F.col("d.route_id") if route_penalty else _none()
        ridden = seen.select("query_id", F.col("to_stop").alias("stop"), on.alias("active"), (F.col("d.arr") + change).cast("int").alias("t"), F.lit(0).alias("kind"), F.col("d.trip_id").alias("trip_id"), "from_stop", "from_active", F.col("d.dep").alias("dep"))
        return ridden.unionByName(_walked(at, moves))

    return _settled(made, queries, onward, moves, [bins], goals, coords, horizon, bool(route_penalty), False, max_steps)


def _dealt(rides: DataFrame) -> DataFrame:
    """rides in a file for each core: what each row holds is looked through in every step, however few bytes it is."""
    return rides.repartition(rides.sparkSession.sparkContext.defaultParallelism)


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _walked(at: DataFrame, moves: DataFrame) -> DataFrame:
    """Labels by moves(from_stop, to_stop, cost), after which one is on no route."""
    return join_counted(at, moves, "from_stop", "inner").select("query_id", F.col("to_stop").alias("stop"), _none().alias("active"), (F.col("t") + F.col("cost")).cast("int").alias("t"), F.lit(1).alias("kind"), _none().alias("trip_id"), "from_stop", "from_active", _none("int").alias("dep"))


def _settled(made, queries, onward, moves, rides, goals, coords, horizon, active: bool, late: bool, max_steps: int) -> DataFrame:
    """Labels step by step, until none improves. onward(at): the labels one step on from labels at(query_id, from_stop, from_active,
    t, limit); moves: what of it is walked; rides: tables whose from_stop are the stops that rides leave. active: whether the route
    one is on is part of the state. late: labels after the horizon count, but are not left.

    Until a label is at a stop that rides leave, queries from one stop walk the same way, but for when they begin. So these walks
    are found once for each first stop; queries go their own ways from the step that meets a ride, and those that meet none
    within the horizon are answered by a join. Walks that meet no ride any more are joined as well."""
    spark, cols = queries.sparkSession, ["query_id", "step", "stop", "active", "t", *STEP]
    label = lambda t: [F.lit(0).alias("step"), "stop", _none().alias("active"), t.cast("int").alias("t"), _none("int").alias("kind"), _none().alias("trip_id"), _none().alias("from_stop"), _none().alias("from_active"), _none("int").alias("dep")]
    queries = cut(queries.select("query_id", "stop", "depart").distinct(), "search-queries")
    one = queries.groupBy("query_id").agg(F.count("*").alias("n"), F.min("stop").alias("first"), F.min("depart").alias("depart"))
    one = cut(one.filter("n = 1").select("query_id", "first", "depart"), "search-single")
    ridden = cut(reduce(DataFrame.unionByName, [r.select(F.col("from_stop").alias("stop")) for r in rides]).distinct(), "search-ridden")
    ways = _ways(moves, ridden, horizon, late, max_steps)
    there = join_counted(ways.filter(F.col("cost") <= horizon), ridden, "stop", "left_semi").groupBy(F.col("first").alias("stop")).agg(F.min("cost").alias("near"))
    near = cut(there.unionByName(ridden.select("stop", F.lit(0).alias("near"))).groupBy("stop").agg(F.min("near").alias("near")), "search-near")

    firsts = cut(one.select(F.col("first").alias("stop")).distinct().select(F.col("stop").alias("query_id"), *label(F.lit(0))), "search-labels")
    span = cut(firsts.select("query_id", F.lit(horizon).alias("limit")), "search-limits")
    (shared,) = _grown(made, [firsts], firsts, span, ways, late, max_steps, ends=ridden)
    walks = kept(cut(shared.withColumnRenamed("query_id", "first"), "search-walks"), made)
    met = join_counted(walks.filter(F.col("t") <= horizon), ridden, "stop", "left_semi").groupBy("first").agg(F.max("step").alias("last"))
    met = cut(met, "search-met")

    own = _followed(join_counted(one, met, "first", "inner"), walks).select(*cols, "last")
    more = queries.join(one, "query_id", "left_anti").select("query_id", *label(F.col("depart")), F.lit(0).alias("last"))
    own = cut(own.unionByName(more), "search-own")
    begun, front = cut(own.select(*cols), "search-labels"), cut(own.filter("step = last").select(*cols), "search-front")
    limit = queries.select("query_id", (F.col("depart") + horizon).alias("limit")).distinct().join(own.groupBy("query_id").agg(F.max("last").alias("begun")), "query_id")
    if goals is not None:
        place = lambda df, a, b: df.join(coords.select("stop", F.col("lat").alias(a), F.col("lon").alias(b)), "stop", "left") if coords is not None else df.withColumns({c: _none("double") for c in (a, b)})
        limit = limit.join(place(goals.select("query_id", "stop"), "goal_lat", "goal_lon").withColumnRenamed("stop", "goal"), "query_id")
    places = cut(coords.select("stop", "lat", "lon"), "search-places") if goals is not None and coords is not None else None
    held = [t.persist() for t in (*rides, moves, near, *([] if places is None else [places]))]
    try:
        steps = _grown(made, [begun], front, cut(limit, "search-limits"), ways, late, max_steps, near, onward=onward, goals=goals is not None, places=places, active=active)
    finally:
        for t in held:
            t.unpersist()
    out = written(spark, [kept(t, made) for t in steps]).select(*cols)

    on_foot = join_counted(one, met, "first", "left_anti")
    if goals is not None:
        there = walks.select("first", "stop", F.col("t").alias("there"))
        on_foot = on_foot.join(goals.select("query_id", "stop"), "query_id").join(there, ["first", "stop"]).groupBy("query_id", "first", "depart").agg(F.max("there").alias("there"))
        return out.unionByName(kept(cut(_followed(on_foot, walks).filter("t - depart <= there").select(*cols), "search-labels"), made))
    return out.unionByName(_followed(kept(cut(on_foot, "search-on-foot"), made), walks).select(*cols))


def _followed(queries: DataFrame, walks: DataFrame) -> DataFrame:
    """The labels of queries(query_id, first, depart) by the walks from their first stops."""
    return queries.join(walks, "first").withColumn("t", (F.col("t") + F.col("depart")).cast("int"))


def _improving(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows(*keys, step, l), where l begins with t, the least of each step that is below those of all steps before."""
    best = rows.groupBy(*keys, "step").agg(F.min("l").alias("l"))
    before = F.min("l.t").over(Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("_before", before).filter("_before is null or l.t < _before").drop("_before")


def _ways(moves: DataFrame, ridden: DataFrame, horizon: int, late: bool, max_steps: int) -> DataFrame:
    """Walks that leave only stops which no ride leaves: first, stop, n (moves), cost, left (the cost before the last move), from_stop.

    Those that improve on walks of fewer moves are found by doubling: what has the most moves so far is continued by all that is
    known. The last move may end after the horizon where `late`."""
    free = cut(join_counted(moves, ridden.withColumnRenamed("stop", "from_stop"), "from_stop", "left_anti").filter("from_stop <> to_stop"), "search-free")
    cost = F.struct(F.col("cost").cast("int").alias("t")).alias("l")
    known, most = cut(free.filter(F.col("cost") <= horizon).select(F.col("from_stop").alias("first"), F.col("to_stop").alias("stop"), F.lit(1).alias("step"), cost), "search-known"), 1
    while rows_of(known) and known.agg(F.max("step")).first()[0] == most:
        if most >= 2 * max_steps:
            raise ValueError(f"labels still improve after {max_steps} steps")
        begun = known.filter(F.col("step") == most).select("first", F.col("stop").alias("mid"), F.col("l.t").alias("a"))
        then = known.select(F.col("first").alias("mid"), "stop", F.col("step").alias("n"), F.col("l.t").alias("b"))
        on = begun.join(few(then, known), "mid").filter(F.col("a") + F.col("b") <= horizon).filter("first <> stop")
        on = on.select("first", "stop", (F.col("n") + most).alias("step"), F.struct((F.col("a") + F.col("b")).alias("t")).alias("l"))
        known, most = cut(_improving(known.unionByName(on), ["first", "stop"]), "search-known"), 2 * most
    self = free.select(F.col("from_stop").alias("first"), F.col("from_stop").alias("stop"), F.lit(0).alias("n"), F.lit(0).alias("left")).distinct()
    last = self.unionByName(known.select("first", "stop", F.col("step").alias("n"), F.col("l.t").alias("left"))).withColumnRenamed("stop", "from_stop")
    ways = join_counted(last, free, "from_stop", "inner").select("first", F.col("to_stop").alias("stop"), (F.col("n") + 1).alias("n"), (F.col("left") + F.col("cost")).cast("int").alias("cost"), "left", "from_stop")
    return cut(ways.filter("first <> stop").filter(F.col("left" if late else "cost") <= horizon), "search-ways")


def _joined_walks(at: DataFrame, ways: DataFrame, late: bool) -> DataFrame:
    """Labels by all walks from labels at(query_id, step, stop, active, t, limit): query_id, step, stop, active and l (t, STEP)."""
    at = at.select("query_id", "step", F.col("stop").alias("first"), "active", "t", "limit")
    on = join_counted(at, ways, "first", "inner").filter(F.col("t") + F.col("left" if late else "cost") <= F.col("limit"))
    l = F.struct((F.col("t") + F.col("cost")).cast("int").alias("t"), F.lit(1).alias("kind"), _none().alias("trip_id"), "from_stop", F.when(F.col("n") == 1, F.col("active")).alias("from_active"), _none("int").alias("dep"))
    return on.select("query_id", (F.col("step") + F.col("n")).alias("step"), "stop", _none().alias("active"), l.alias("l"))


def _grown(made, steps, front, limit, ways, late, max_steps, near=None, ends=None, onward=None, goals: bool = False, places=None, active: bool = False) -> list[DataFrame]:
    """The written tables of labels `steps` and those that follow from the labels `front` of them. limit(query_id, limit[, begun, goal,
    goal_lat, goal_lon]), where `begun` is the step of a query's labels in front. ways: see _ways().

    With onward, labels grow step by step as long as a stop that rides leave is near enough to be reached; near(stop, near) tells the
    seconds there. What follows from the other ones is walked, and joined. Without onward all labels are of this kind, and walks end
    with the step that is first at one of the stops `ends`. Where goals are given, walks are kept that lead to them soonest."""
    spark, cols = limit.sparkSession, ["query_id", "step", "stop", "active", "t", *STEP]
    packed = lambda df: df.select("query_id", "step", "stop", "active", F.struct("t", *STEP).alias("l"))
    tables, at = [*steps], join_counted(front, limit, "query_id", "inner")
    if onward is not None:
        tables = _stepped(made, steps, front, limit, near, onward, goals, places, active, late, max_steps)
        grown = join_counted(written(spark, tables[len(steps) :]).select(*cols), limit, "query_id", "inner") if len(tables) > len(steps) else at.limit(0)
        at = join_counted(at.unionByName(grown), near, "stop").filter("t <= limit and (near is null or t + near > limit)")
        at = cut(at.select("query_id", "step", "stop", "active", "t", *[c for c in limit.columns if c != "query_id"]), "search-far")
        if not rows_of(at):
            return tables
    if goals:
        return [*tables, *_walked_to_goals(made, written(spark, tables), at, ways, late, max_steps)]
    all_ = _improving(packed(written(spark, tables).select(*cols)).unionByName(_joined_walks(at, ways, late)), ["query_id", "stop", "active"]).select("query_id", "step", "stop", "active", "l.*")
    if ends is not None:
        done = join_counted(join_counted(all_, limit, "query_id", "inner").filter("t <= limit"), ends, "stop", "left_semi").groupBy("query_id").agg(F.min("step").alias("done"))
        all_ = all_.join(done, "query_id", "left").filter("done is null or step <= done").select(*cols)
    return [_checked(kept(cut(all_, "search-labels"), made), max_steps)]


def _walked_to_goals(made, found, at, ways, late, max_steps) -> list[DataFrame]:
    """The labels on the soonest walks to the goals from labels at(..., goal), where they are better than what was found."""
    on = join_counted(at.select("query_id", "step", F.col("stop").alias("first"), "t", "limit", F.col("goal").alias("stop")), ways, ["first", "stop"], "inner").filter(F.col("t") + F.col("left" if late else "cost") <= F.col("limit"))
    on = on.select("query_id", F.col("t") + F.col("cost"), F.col("step") + F.col("n")).toDF("query_id", "there", "end").groupBy("query_id").agg(F.min(F.struct("there", "end")).alias("g"))
    goal = at.select("query_id", "goal").distinct()
    had = found.join(goal, [found["query_id"] == goal["query_id"], found["stop"] == goal["goal"]]).groupBy(found["query_id"]).agg(F.min(F.struct("t", "step")).alias("had"))
    better = cut(on.join(had, "query_id", "left").filter("had is null or g.there < had.t or (g.there = had.t and g.end < had.step)").select("query_id", "g.*"), "search-better")
    if not rows_of(better):
        return []
    ending = at.join(few(better, better), "query_id")
    walked = _joined_walks(ending, ways, late).join(few(better.join(goal, "query_id"), better), "query_id")
    to = ways.select(F.col("first").alias("stop"), F.col("stop").alias("goal"), "n", "cost").distinct()
    walked = walked.withColumn("n", F.col("end") - F.col("step")).withColumn("cost", F.col("there") - F.col("l.t"))
    there, before = walked.filter("stop = goal and n = 0 and cost = 0"), walked.filter("n > 0").join(few(to, ways), ["stop", "goal", "n", "cost"], "left_semi")
    rows = there.unionByName(before).groupBy("query_id", "step", "stop", "active").agg(F.min("l").alias("l")).select("query_id", "step", "stop", "active", "l.*")
    return [_checked(kept(cut(rows, "search-labels"), made), max_steps)]


def _checked(labels: DataFrame, max_steps: int) -> DataFrame:
    if (labels.agg(F.max("step")).first()[0] or 0) >= max_steps:
        raise ValueError(f"labels still improve after {max_steps} steps")
    return labels


def _stepped(made, steps, front, limit, near, onward, goals: bool, places, active, late, max_steps) -> list[DataFrame]:
    """The written tables `steps` and those of the steps on from front. See _grown().

    What was found is not written again at each step: a step's candidates, which are few, are looked for in it. What is looked in
    is put together every few steps, so there are never many tables."""
    spark, keys = limit.sparkSession, ["query_id", "stop", "active"] if active else ["query_id", "stop"]
    cols, more = ["query_id", "step", "stop", "active", "t", *STEP], [c for c in limit.columns if c != "query_id"]
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    going = lambda df: join_counted(df, near, "stop").withColumn("going", F.coalesce(F.col("t") + F.col("near") <= F.col("limit"), F.lit(False))).drop("near")
    steps, seen, n, found = [*steps], list(steps), 0, sum(map(rows_of, steps))
    at = cut(going(join_counted(front, limit, "query_id", "inner")).select(*cols, *more, "going"), "search-front")
    there = []
    while True:
        n += 1
        from_ = at.filter("going").select("query_id", F.col("stop").alias("from_stop"), F.col("active").alias("from_active"), "t", "limit")
        from_._rows = rows_of(at)
        new = onward(from_).groupBy("query_id", "stop", "active").agg(F.min(F.struct("t", *STEP)).alias("l")).select("query_id", "stop", "active", "l.*")
        new = join_counted(new, limit, "query_id", "inner")
        new = going(new if late else new.filter("t <= limit"))
        if goals:
            if places is not None:
                new = join_counted(new, places, "stop").withColumn("t2", F.col("t") + lower_bound(F.col("lat"), F.col("lon"), F.col("goal_lat"), F.col("goal_lon")))
            else:
                new = new.withColumn("t2", F.col("t"))
            if n == 1:
                there = [cut(join_counted(written(spark, steps), limit, "query_id", "inner").filter("stop = goal").select("query_id", F.col("t").alias("there")), "search-there")]
            bound = reduce(DataFrame.unionByName, there)
            new = new.join(few(bound, limit), [new["query_id"] == bound["query_id"], bound["there"] <= new["t2"]], "left_anti")
        new = new.select("query_id", (F.col("begun") + n).alias("step"), "stop", "active", "t", *STEP, *more, "going")
        old = written(spark, seen).select("query_id", "stop", "active", F.col("t").alias("_old"))
        if found > FEW:
            # Of all that was found, only what the candidates are no earlier than is of interest.
            new = cut(new, "search-candidates")
            asked = few(new.select("query_id", "stop", "active", "t"), new)
            old = few(old.join(asked, [*same(old, asked), old["_old"] <= asked["t"]]).select(*[asked[k] for k in keys], "_old"), new)
        else:
            old = F.broadcast(old)
        told = Observation()
        new = new.join(old, [*same(new, old), old["_old"] <= new["t"]], "left_anti")
        at = kept(cut(new.observe(told, F.count(F.lit(1)).alias("rows"), F.count_if("going").alias("going"), F.max("step").alias("last")), "search-labels"), made)
        at._rows = told.get["rows"]
        if not rows_of(at):
            return steps
        if n == max_steps or told.get["last"] >= max_steps:
            raise ValueError(f"labels still improve after {max_steps} steps")
        steps.append(at)
        seen.append(at)
        found += rows_of(at)
        if not told.get["going"]:
            return steps
        if goals:
            there.append(at.filter("stop = goal").select("query_id", F.col("t").alias("there")))
        if len(seen) > TABLES:
            seen = [cut(written(spark, seen).select("query_id", "step", "stop", "active", "t", *STEP), "search-seen")]
            if goals:
                there = [cut(reduce(DataFrame.unionByName, there).groupBy("query_id").agg(F.min("there").alias("there")), "search-there")]


def edge_labels(queries: DataFrame, edges: DataFrame, goals: DataFrame | None = None, coords: DataFrame | None = None, horizon: int = 14_400, max_wait: int | None = None, penalty: int = 0, change_penalty: int = 0, state_by: str = "route", zero_missing: bool = False, max_steps: int = 400) -> DataFrame:
    """labels() over edges of any kind, timed or not: from_stop, to_stop, kind (trip and ride are rides, others are walked), weight,
    headway, dep, arr, trip_id, route_id, apply_penalty.

    A ride with dep and arr leaves at dep, if that is within max_wait; it is left out if it arrives before that. Any other ride
    leaves after half its headway (rounded down, at once without one), if that is within max_wait, and takes its weight. At each
    label, of all rides of one route (state_by "route"; of one trip with "trip"; the other one where that is unknown) only the
    first to leave is taken, whichever stop it goes to; ties go to the earliest arrival, then stop and trip. Rides of neither
    route nor trip are all taken. A ride on another route (trip) than the one that the label is on costs change_penalty; a
    transfer whose penalty applies costs `penalty`, and after anything walked one is on none. Edges without a weight are left
    out, or take no time with zero_missing. Labels after the horizon count, but are not left.

    Rides that are not timed do not depend on the label's time, so the first of each group at a stop is found once, beforehand;
    timed ones are found in bins of max_wait seconds. What a label can take is then one row a group, of which a partial minimum
    chooses, so no label sees a stop's whole day, nor all of its targets. Where a group has one ride at a stop and changes cost
    nothing, as with trips, only the soonest to arrive at each next stop can matter, and is found as in soonest_bins()."""
    if state_by not in ("route", "trip"):
        raise ValueError("state_by is route or trip")
    if max_wait is not None and max_wait <= 0:
        raise ValueError("max_wait must be above 0")
    with passing(queries.sparkSession) as made:
        return _edge_labels(made, queries, edges, goals, coords, horizon, max_wait, penalty, change_penalty, state_by, zero_missing, max_steps)


def _edge_labels(made, queries, edges, goals, coords, horizon, max_wait, penalty, change_penalty, state_by, zero_missing, max_steps) -> DataFrame:
    route, trip = F.concat(F.lit("route "), "route_id"), F.concat(F.lit("trip "), "trip_id")
    alone = F.concat_ws(" ", F.lit("edge"), "to_stop", "dep", "arr", "weight", "headway")
    group = F.coalesce(route, trip, alone) if state_by == "route" else F.coalesce(trip, route, alone)
    rides = edges.filter("kind in ('trip', 'ride')").withColumn("grp", group)
    weight = F.coalesce("weight", F.lit(0)) if zero_missing else F.col("weight")

    timed = rides.filter("dep is not null and arr is not null and arr >= dep")
    width = max(1, max_wait // BINS) if max_wait else None
    item = F.struct("dep", "arr", "to_stop", "trip_id", "route_id")
    timed = timed.groupBy("from_stop", "grp", "dep").agg(F.min(item).alias("d"))

    wait = F.when(F.col("headway") > 0, F.floor(F.col("headway") / 2)).otherwise(0).cast("int")
    steady = rides.filter("dep is null or arr is null").select("from_stop", "grp", F.struct(wait.alias("wait"), weight.alias("ride"), "to_stop", "trip_id", "route_id").alias("d"))
    steady = steady.filter("d.ride is not null").filter(F.col("d.wait") <= (max_wait if max_wait is not None else 1 << 30))
    steady = cut(steady.groupBy("from_stop", "grp").agg(F.min("d").alias("d")), "search-steady")

    single = None
    if max_wait and not change_penalty:
        once = cut(timed.groupBy("from_stop", "grp").agg(F.count("*").alias("n"), F.min("d").alias("d")).join(steady.select("from_stop", "grp", F.lit(True).alias("other")), ["from_stop", "grp"], "left"), "search-groups")
        single = cut(_dealt(soonest_bins(once.filter("n = 1 and other is null").select("from_stop", "d.*"), max_wait)), "search-single")
        timed = timed.join(once.filter("n > 1 or other").select("from_stop", "grp"), ["from_stop", "grp"], "left_semi")
    if max_wait:
        timed = next_bins(timed, ["from_stop", "grp"], width, max_wait)
    else:
        timed = timed.groupBy("from_stop", F.lit(0).cast("long").alias("bin"), "grp").agg(F.array_sort(F.collect_list("d")).alias("deps"))
    timed = cut(_dealt(timed), "search-timed")

    cost = weight + F.when((F.col("kind") == "transfer") & F.coalesce("apply_penalty", F.lit(True)), penalty).otherwise(0)
    moves = edges.filter("kind not in ('trip', 'ride')").select("from_stop", "to_stop", cost.alias("cost")).filter("cost is not null")
    moves = cut(moves.groupBy("from_stop", "to_stop").agg(F.min("cost").alias("cost")), "search-moves")
    on = F.col("d.route_id" if state_by == "route" else "d.trip_id")
    told = ["query_id", "from_stop", "from_active", "grp"]

    def onward(at: DataFrame) -> DataFrame:
        bin_ = F.floor(F.col("t") / width) if max_wait else F.lit(0).cast("long")
        fits = lambda d: (d["dep"] >= F.col("t")) & (d["dep"] - F.col("t") <= max_wait if max_wait else F.lit(True))
        seen = timed.join(few(at.withColumn("bin", bin_), at), ["from_stop", "bin"]).withColumn("d", F.get(F.filter("deps", fits), F.lit(0))).filter("d is not null")
        chosen = lambda leaves, arrives, dep: F.struct(leaves.cast("int").alias("leaves"), arrives.cast("int").alias("arr"), F.col("d.to_stop").alias("to_stop"), F.col("d.trip_id").alias("trip_id"), F.col("d.route_id").alias("route_id"), dep.cast("int").alias("dep")).alias("d")
        one = seen.select(*told, chosen(F.col("d.dep"), F.col("d.arr"), F.col("d.dep")))
        left = F.col("t") + F.col("d.wait")
        two = join_counted(at, steady, "from_stop", "inner").select(*told, chosen(left, left + F.col("d.ride"), _none("int")))
        first = one.unionByName(two).groupBy(*told).agg(F.min("d").alias("d"))
        other = F.col("from_active").isNotNull() & F.col("d.trip_id").isNotNull() & ~F.col("from_active").eqNullSafe(on)
        ridden = first.select("query_id", F.col("d.to_stop").alias("stop"), (on if change_penalty else _none()).alias("active"), (F.col("d.arr") + F.when(other, change_penalty).otherwise(0)).cast("int").alias("t"), F.lit(0).alias("kind"), F.col("d.trip_id").alias("trip_id"), "from_stop", "from_active", F.col("d.dep").alias("dep"))
        if single is not None:
            met = single.join(few(at.withColumn("bin", F.floor(F.col("t") / max_wait)), at), ["from_stop", "bin"])
            # The best from t to the end of its bin, and of the next bin until the wait is over.
            own, then = F.get(F.filter("own", lambda d: d["dep"] >= F.col("t")), F.lit(0))["best"], F.filter("next", lambda d: d["dep"] <= F.col("t") + max_wait)
            met = met.withColumn("b", F.least(own, F.get(then, F.size(then) - 1)["best"])).filter("b is not null")
            ridden = ridden.unionByName(met.select("query_id", F.col("to_stop").alias("stop"), _none().alias("active"), F.col("b.arr").cast("int").alias("t"), F.lit(0).alias("kind"), F.col("b.trip_id").alias("trip_id"), "from_stop", "from_active", F.col("b.dep").cast("int").alias("dep")))
        return ridden.unionByName(_walked(at, moves))

    return _settled(made, queries, onward, moves, [timed, steady, *([] if single is None else [single])], goals, coords, horizon, bool(change_penalty), True, max_steps)


def earliest_arrivals(queries: DataFrame, rides: DataFrame, transfers: DataFrame, horizon: int = 14_400, max_wait: int | None = 1_200, penalty: int = 0, max_steps: int = 400, **options) -> DataFrame:
    """Earliest arrival at every stop, and the hops of the way there: query_id, stop, t, hops. See labels()."""
    found = labels(queries, rides, transfers, horizon=horizon, max_wait=max_wait, penalty=penalty, max_steps=max_steps, **options)
    return found.groupBy("query_id", "stop").agg(F.min(F.struct("t", "step")).alias("b")).select("query_id", "stop", "b.t", F.col("b.step").alias("hops"))


def hops(found: DataFrame, goals: DataFrame) -> DataFrame:
    """The way to each goal reached: query_id, pos (from 0), kind (trip, transfer), from_stop, to_stop, trip_id, dep, arr. arr has
    the route penalty in it, as the search counts it.

    A query's labels are dealt to one task, where those before its goal's earliest one are read from the last step to the first."""
    spark = importable(found.sparkSession)
    at = goals.join(found, ["query_id", "stop"]).groupBy("query_id").agg(F.min(F.struct("t", "step", "stop", "active")).alias("g"))
    with passing(spark) as made:
        at = kept(cut(at.select("query_id", F.col("g.step").alias("end_step"), F.col("g.stop").alias("end_stop"), F.col("g.active").alias("end_active")), "hop-ends"), made)
    before = join_counted(found, at, "query_id", "inner").filter("from_stop is not null and step <= end_step")
    asked = before.select("query_id", "step", "stop", "active", "t", *STEP, "end_step", "end_stop", "end_active")
    asked = asked.repartition("query_id").sortWithinPartitions("query_id", F.desc("step"), "t", *STEP)
    rows = asked.mapInArrow(_way_back, asked.schema)
    return rows.select("query_id", (F.col("step") - 1).alias("pos"), F.when(F.col("kind") == 0, "trip").otherwise("transfer").alias("kind"), "from_stop", F.col("stop").alias("to_stop"), "trip_id", "dep", F.col("t").alias("arr"))


def _way_back(batches: Iterator) -> Iterator:
    """Of labels by query and falling step, those on the way to each query's end."""
    query = want = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("query_id", "step", "stop", "active", "from_stop", "from_active", "end_step", "end_stop", "end_active")]
        took = []
        for i, (q, step, stop, active, from_stop, from_active, *end) in enumerate(zip(*columns)):
            if q != query or want is None:
                query, want = q, tuple(end)
            if (step, stop, active) == want:
                took.append(i)
                want = (step - 1, from_stop, from_active)
        if took:
            yield batch.take(took)
