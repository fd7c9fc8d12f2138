"""Operators over ordered rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut, join_counted


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given (ascending) order, as a partial aggregate: no key's rows are sorted."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def row_numbers(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with `name`, each row's place from 1 in the order of `by`: sorted range by range, the ranges counted, so no task sorts
    all rows."""
    rows = cut(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = cut(rows.groupBy(part.alias("_p")).count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o")), "number-offsets")
    at = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_o") + 1
    return join_counted(rows.withColumn("_p", part), counts, "_p", "inner").withColumn(name, at).drop("_m", "_p", "_o")


def top_by(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def islands(df: DataFrame, keys: list[str], order: list[Column], changed: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a new one begins where `changed` (which may use F.lag over the same window) is true."""
    w = Window.partitionBy(*keys).orderBy(*order)
    begun = F.coalesce(changed, F.lit(True)).cast("int")
    return df.withColumn("_new", begun).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def lower_median(values: Column) -> Column:
    """Middle of the sorted non-null values; of two middle ones, their mean rounded down."""
    s = F.sort_array(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s)
    mid = F.floor((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
    return F.when(n > 0, mid)


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], at: str, time: str, order: list[str], within: int | None = None) -> DataFrame:
    """For each left row, the first right row of its keys with time >= at (at most `within` later); ties by `order`. Rows that are
    alike in all columns count once. Null keys and times match nothing.

    With a limit, right rows are gathered into sorted arrays by key and bin of `within` (each in its own bin and the one
    before), so a left row meets one array and not its key's other rows. Without one, both sides are merged by key in order of
    time, last first, and each left row takes what was passed last."""
    rest = [c for c in right.columns if c not in keys]
    item = F.struct(time, *order, *[c for c in rest if c not in (time, *order)])
    back = lambda b: [F.col(f"{b}.{c}").alias(c) for c in rest]
    right = right.filter(F.col(time).isNotNull())
    if within is not None:
        width = within + 1
        bin_ = F.floor(F.col(time) / width)
        bins = right.select(*keys, item.alias("_d"), F.explode(F.array(bin_, bin_ - 1)).alias("_bin"))
        bins = bins.groupBy(*keys, "_bin").agg(F.array_sort(F.collect_set("_d")).alias("_deps"))
        fits = lambda d: (d[time] >= F.col(at)) & (d[time] <= F.col(at) + within)
        got = left.withColumn("_bin", F.floor(F.col(at) / width)).join(bins, [*keys, "_bin"])
        got = got.withColumn("_b", F.get(F.filter("_deps", fits), F.lit(0))).filter("_b is not null")
        return got.select(*left.columns, *back("_b"))
    one = left.filter(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_t"), F.struct(*[c for c in left.columns if c not in keys]).alias("_l"), F.lit(None).cast(right.select(item.alias("i")).schema["i"].dataType).alias("_d"))
    two = right.select(*keys, F.col(time).alias("_t"), F.lit(None).cast(one.schema["_l"].dataType).alias("_l"), item.alias("_d"))
    # Last first, and at one time right rows before left ones, the first of them last.
    passed = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.col("_d").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    got = one.unionByName(two).withColumn("_b", F.last("_d", ignorenulls=True).over(passed)).filter("_l is not null and _b is not null")
    for k in keys:
        got = got.filter(F.col(k).isNotNull())
    return got.select(*[F.col(c) if c in keys else F.col(f"_l.{c}").alias(c) for c in left.columns], *back("_b"))
