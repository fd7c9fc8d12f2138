"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, join_counted, kept, passing, word_count

#: Bins of one refinement step; two steps part a source's ranks into BINS ** 2 cells.
BINS = 4096


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with _at, their place from 0 in the order of `by`: sorted by ranges, and counted range by range."""
    rows = cut(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_m", F.monotonically_increasing_id()), "mix-ordered")
    part = F.shiftright("_m", 33)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = cut(rows.groupBy(part.alias("_p")).count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o")), "mix-places")
    at = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_o")
    return join_counted(rows.withColumn("_p", part), counts, "_p", "inner").withColumn("_at", at).drop("_m", "_p", "_o")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes(_src, source_size), one row a source -> with target.

    Sources in _src's order weigh weights[0], weights[1], ... in turn and share `share` times all sizes by weight; no
    target is above cap times its source's size, and what that leaves over is shared among the others by weight. The level of
    the others rises with every source found above its cap, until none is; each pass is a sum over the sources, and all
    numbers summed are whole, so reruns agree."""
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_at") % len(weights) + 1).cast("int"))
    rows = numbered(sizes.select("_src", "source_size"), "_src").select("_src", "source_size", w.alias("_w"), (F.col("source_size") * F.lit(float(cap))).alias("_cap"))
    rows = cut(rows, "mix-sources")
    level, was = 0.0, None
    while level != was:
        above = F.col("_w") * F.lit(level) > F.col("_cap")
        total, full, rest = rows.agg(F.sum("source_size"), F.sum(F.when(above, F.col("_cap"))), F.sum(F.when(~above, F.col("_w")))).first()
        was, level = level, (share * total - (full or 0.0)) / rest if rest else level
    return rows.select("_src", "source_size", F.least("_cap", F.when(F.lit(level) * F.col("_w") <= F.col("_cap"), F.lit(level) * F.col("_w")).otherwise(F.col("_cap"))).alias("target"))


def levels(classes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """classes(_src, _w, _n words), targets(_src, target) -> _src, source_size, target, _level: a document's expected copies
    are least(cap, _level * _w), and those of a source take its target in words. As in source_targets(), for all at once."""
    now, before = None, -1.0
    while True:
        rows = classes.join(targets, "_src") if now is None else classes.join(now.select("_src", "source_size", "target", "_level"), "_src")
        full = F.col("_w") * F.col("_level") >= cap if now is not None else F.lit(False)
        sums = rows.groupBy("_src").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(F.when(full, F.col("_n")).otherwise(0)).alias("_full"), F.sum(F.when(~full, F.col("_w") * F.col("_n")).otherwise(0.0)).alias("_rest"))
        level = F.when(F.col("_rest") > 0, (F.col("target") - cap * F.col("_full")) / F.col("_rest")).otherwise(float("inf"))
        now = cut(sums.withColumn("_level", level), "mix-levels")
        all_full = now.agg(F.sum("_full")).first()[0] or 0
        if all_full == before:
            return now.select("_src", "source_size", "target", "_level")
        before = all_full


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on key and seed alone, so reruns agree."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)


def pareto_mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7, by_size: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, draw_col: str | None = None) -> DataFrame:
    """One row for each row of docs: id, size (words), source_size, target, copies, taken = copies * size.

    A document weighs weight_col (else 1), times the number of binary digits of its size if by_size: long documents are then
    taken more often. Its expected copies are e = least(cap, level * weight), where the source's level makes them take its
    target. It surely gets floor(e) copies; pi = e - floor(e) is its inclusion probability for one more. Those are drawn in
    Pareto order: by U/(1-U) over pi/(1-pi), U uniform by draw_col (else the id), the text and seed, in fixed size, here as
    many documents as bring the source's words nearest to its target. The cut in that order is found from word sums by bins of
    the rank, in two steps of BINS bins, then among the ranks of one cell; rows of one rank, which repeat id and text, are
    parted alike by a second number, drawn by their place. So no source's rows meet in one task, only sums for each source move.

    Null source: a source of its own, last. Null or empty text: size 0, 0 taken. Null ids are drawn by their texts. Null weight:
    0, never taken; if no other weight is left, its source stays below its target. Repeated rows are documents of their own.
    No rows in, no rows out. Other columns are not read."""
    with passing(docs.sparkSession) as made:
        return _pareto_mix(made, docs, weights, share, cap, seed, by_size, id_col, text_col, source_col, weight_col, draw_col)


def _pareto_mix(made, docs, weights, share, cap, seed, by_size, id_col, text_col, source_col, weight_col, draw_col) -> DataFrame:
    src = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(source_col)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), F.concat_ws(":", F.coalesce(F.col(draw_col or id_col).cast("string"), F.lit("null")), F.xxhash64(text)).alias("_draw"), src.alias("_src"), word_count(text).alias("size"), (F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0)).alias("_given"))
    digits = F.char_length(F.bin("size")).cast("double")
    base = cut(base.withColumn("_w", F.col("_given") * digits if by_size else F.col("_given")).drop("_given").withColumn("_place", F.monotonically_increasing_id()), "mix-sizes")
    classes = cut(base.groupBy("_src", "_w").agg(F.sum("size").alias("_n")), "mix-classes")
    targets = source_targets(classes.groupBy("_src").agg(F.sum("_n").alias("source_size")), weights, share, cap)
    targets = levels(classes, targets, cap)

    e = F.when(F.col("_w") > 0, F.least(F.lit(float(cap)), F.col("_level") * F.col("_w"))).otherwise(0.0)
    rows = join_counted(base, targets, "_src").withColumn("_e", e).withColumn("_sure", F.floor("_e"))
    pi = F.col("_e") - F.col("_sure")
    u = uniform(F.col("_draw"), seed)
    odds = (u / (1 - u)) * ((1 - pi) / pi)
    rank = F.when((pi > 0) & (F.col("size") > 0), odds / (1 + odds))  # order-preserving, in (0, 1)
    rows = kept(cut(rows.withColumn("_v", rank).withColumn("_u", uniform(F.col("_place"), seed + 1)).drop("_w", "_e", "_draw", "_place", "_level"), "mix-ranked"), made)

    left = rows.groupBy("_src").agg((F.first("target") - F.sum(F.col("_sure") * F.col("size"))).alias("_left"))
    bins = lambda c, a, b: {a: F.floor(F.col(c) * BINS), b: F.floor((F.col(c) * BINS - F.floor(F.col(c) * BINS)) * BINS)}
    ranked = rows.filter("_v is not null").withColumns(bins("_v", "_b1", "_b2") | bins("_u", "_b3", "_b4"))

    def step(within: DataFrame, left: DataFrame, keys: list[str], by: str) -> DataFrame:
        """For each source, the bin in which the words still wanted run out, what is wanted from it, and its rows."""
        sums = within.groupBy("_src", *keys, by).agg(F.sum("size").alias("_n"), F.count("*").alias("_rows"), F.min("_u").alias("_least"), F.min("size").alias("_size"))
        upto = F.sum("_n").over(Window.partitionBy("_src").orderBy(by))
        sums = sums.join(left.select("_src", *keys, "_left"), ["_src", *keys]).withColumn("_cum", upto)
        at = F.min(F.struct(by, (F.col("_left") - F.col("_cum") + F.col("_n")).alias("_left"), "_rows", "_least", "_size")).alias("_at")
        return cut(sums.filter(F.col("_cum") >= F.col("_left")).groupBy("_src", *keys).agg(at).select("_src", *keys, "_at.*"), "mix-step")

    keys: list[str] = []
    for by in ("_b1", "_b2", "_v", "_b3", "_b4", "_u"):
        if by == "_b3" and left.filter("_rows > 1").isEmpty():
            break
        within = join_counted(ranked, left.select("_src", *keys), ["_src", *keys], "inner") if keys else ranked
        left, keys = step(within, left, keys, by), [*keys, by]
    # The row at the cut is taken if that brings the source nearer to its target.
    cuts = left.select("_src", F.col("_v").alias("_cv"), (F.col("_u") if "_u" in keys else F.col("_least")).alias("_cu"), (F.col("_left") > F.col("_size") / 2).alias("_in"))
    cuts = kept(cut(targets.select("_src").join(cuts, "_src", "left"), "mix-cuts"), made)

    # Without a cut all ranked rows together stay below what is wanted.
    v, same = F.col("_v"), F.col("_v") == F.col("_cv")
    more = v.isNotNull() & (F.col("_cv").isNull() | (v < F.col("_cv")) | (same & (F.col("_u") < F.col("_cu"))) | (same & (F.col("_u") == F.col("_cu")) & F.col("_in")))
    copies = F.col("_sure") + more.cast("long")
    out = join_counted(rows, cuts, "_src").withColumn("copies", copies)
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
