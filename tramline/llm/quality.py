"""Quality rules: fixed rules, then robust multivariate outliers per language and source (minimum covariance determinant)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, join_counted, kept, let, passing, words

SYMBOLS = "#*$%&|<>"
#: Transformed statistics and the least standard deviation each is taken to have (a rule that most documents meet exactly has none).
FEATURES = {"log_words": 0.30, "log_word_length": 0.06, "symbol_rate": 0.10, "dup_line_rate": 0.10, "repeat_rate": 0.10}


def text_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a text; all 0 for null.

    n_repeat_words: windows of five words are hashed and sorted with their places; places whose hash occurs more than once
    are kept in order, and each covers five words or up to the next place."""
    text = F.coalesce(text, F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = lambda s, k: F.get(s, k)["h"]
        marked = let(pairs, lambda s: F.transform(s, lambda x, k: F.when((x["h"] == at(s, k - 1)) | (x["h"] == at(s, k + 1)), x["i"])))
        places = F.sort_array(F.filter(marked, lambda x: x.isNotNull()))
        spread = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
        return let(places, spread)

    def repeats(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - 4), lambda i: F.xxhash64(F.slice(ws, i, 5)))
        hashes = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
        return F.when(F.size(ws) >= 6, hashes).otherwise(0)

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return F.struct(
        let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeats(ws).cast("long").alias("n_repeat_words"))).alias("w"),
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length(bare) - F.char_length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )


def features() -> dict[str, Column]:
    """Transforms that bring the statistics near a bell shape; only for rows of one word or more."""
    rate = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    made = (F.log(F.greatest(F.col("n_words"), F.lit(1))), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), rate("n_symbols", "n_words"), rate("n_dup_lines", "n_lines"), rate("n_repeat_words", "n_words"))
    return dict(zip(FEATURES, made))


def chi2_below(d: int, x: float) -> float:
    """Probability that a chi-square variable of d degrees of freedom is at most x: the series of the incomplete gamma."""
    a, z = d / 2, x / 2
    term = total = math.exp(a * math.log(z) - z - math.lgamma(a + 1)) if x > 0 else 0.0
    n = a
    while term > total * 1e-17:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total)


def chi2_quantile(d: int, p: float) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(d, mid) < p else (low, mid)
    return high


def consistency(d: int, share: float) -> float:
    """What the covariance of the `share` of a normal cloud with the least distances is multiplied by to be the cloud's."""
    return share / chi2_below(d + 2, chi2_quantile(d, share))


def factored(fits: DataFrame, d: int) -> DataFrame:
    """fits with means m_* and covariances c_*_* -> with Cholesky factors l_*_* in their place, and _det, the logarithm of the
    determinant."""
    keep = [c for c in fits.columns if not c.startswith("c_")]
    for i in range(d):
        for j in range(i + 1):
            left = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{j}_{i}"))
            fits = fits.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.col(f"l_{j}_{j}"))
    det = 2 * reduce(lambda a, b: a + b, [F.log(F.col(f"l_{i}_{i}")) for i in range(d)])
    return fits.select(*keep, *[f"l_{i}_{j}" for i in range(d) for j in range(i + 1)], det.alias("_det"))


def with_distance(rows: DataFrame, fits: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """keep's columns of rows and fits, and _d2, the squared Mahalanobis distance under the fit, for each fit of a row's group."""
    rows = join_counted(rows, fits, "_group")
    for i, name in enumerate(names):
        z = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"z_{k}"), range(i), F.col(name) - F.col(f"m_{i}")) / F.col(f"l_{i}_{i}")
        rows = rows.withColumn(f"z_{i}", z)
    return rows.select(*keep, reduce(lambda a, b: a + b, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(names))]).alias("_d2"))


def moments(rows: DataFrame, names: list[str], keys: list[str], inflate: float = 1.0) -> DataFrame:
    """Mean and covariance (times inflate) by keys, plus the floors of FEATURES on the diagonal."""
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy(*keys).agg(*[F.avg(n).alias(f"m_{i}") for i, n in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i, j in pairs])
    floors = list(FEATURES.values())
    return sums.select(*keys, *[f"m_{i}" for i in range(d)], *[(F.col(f"c_{i}_{j}") * inflate + F.lit(floors[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in pairs])


def starts(rows: DataFrame, names: list[str]) -> DataFrame:
    """First fits of each group: by median and median absolute deviation; by all rows; by the rows within 2.5 such deviations
    of the median in every statistic."""
    d, floors = len(names), list(FEATURES.values())
    mid = cut(rows.groupBy("_group").agg(*[F.percentile_approx(n, 0.5).alias(f"m_{i}") for i, n in enumerate(names)]), "mcd-median")
    off = join_counted(rows, mid, "_group").select("_group", *[F.abs(F.col(n) - F.col(f"m_{i}")).alias(n) for i, n in enumerate(names)])
    spread = off.groupBy("_group").agg(*[F.percentile_approx(n, 0.5).alias(f"s_{i}") for i, n in enumerate(names)])
    wide = lambda i: F.sqrt(F.pow(F.col(f"s_{i}") * 1.4826, 2) + F.lit(floors[i] ** 2))
    robust = cut(mid.join(spread, "_group"), "mcd-spread")
    first = robust.select("_group", *[f"m_{i}" for i in range(d)], *[(F.pow(wide(i), 2) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(d) for j in range(i, d)])
    near = reduce(lambda a, b: a & b, [F.abs(F.col(n) - F.col(f"m_{i}")) <= 2.5 * wide(i) for i, n in enumerate(names)])
    boxed = moments(join_counted(rows, robust, "_group").filter(near).select("_group", *names), names, ["_group"])
    made = [first, moments(rows, names, ["_group"]), boxed]
    return reduce(DataFrame.unionByName, [f.withColumn("_start", F.lit(i)) for i, f in enumerate(made)])


def mcd_fits(rows: DataFrame, names: list[str], half: float = 0.75, steps: int = 12, still: float = 1e-4) -> DataFrame:
    """rows(_group, *names) -> _group, m_*, l_*_*, _det: each group's minimum covariance determinant fit, reweighted.

    From each of several starts, a concentration step fits mean and covariance to the `half` share of a group with the least
    distances, which never raises the determinant; steps go on until no determinant falls by `still` (in logarithm), or
    `steps`. The start of the least determinant wins. The last fit takes all rows within the 0.975 quantile of the chi-square
    law under it. Covariances are made consistent for a normal cloud. The quantile of the distances comes from mergeable
    summaries, so a group of any size only moves partial sums."""
    d, keys = len(names), ["_group", "_start"]
    fits, scale = cut(factored(starts(rows, names), d), "mcd-fit"), consistency(d, half)
    for _ in range(steps):
        scored = with_distance(rows, fits, names, [*keys, *names])
        bound = cut(scored.groupBy(*keys).agg(F.percentile_approx("_d2", half).alias("_bound")), "mcd-bound")
        inner = join_counted(scored, bound, keys, "inner").filter(F.col("_d2") <= F.col("_bound"))
        new = cut(factored(moments(inner, names, keys, scale), d), "mcd-fit")
        fell = fits.select(*keys, F.col("_det").alias("_was")).join(new, keys).filter(F.abs(F.col("_was") - F.col("_det")) > still)
        fits, moved = new, not fell.isEmpty()
        if not moved:
            break
    best = cut(fits.groupBy("_group").agg(F.min(F.struct("_det", "_start", *[c for c in fits.columns if c[:2] in ("m_", "l_")])).alias("b")).select("_group", "b.*"), "mcd-best")
    sure = with_distance(rows, best, names, ["_group", *names]).filter(F.col("_d2") <= chi2_quantile(d, 0.975))
    return cut(factored(moments(sure, names, ["_group"], consistency(d, 0.975)), d), "mcd-fit")


def quality_rules(docs: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, min_group: int = 50, tail: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept,
    and docs' columns named in keep.

    base_failed: fewer than min_words words, or more than max_repeat_percent of the words lie in repeated five-word windows.
    The others are judged by the squared Mahalanobis distance d2 of their transformed statistics under their language and
    source's mcd_fits(): kept if d2 is at most the chi-square quantile that a normal row exceeds with probability `tail` (one
    clean document in a million). Rows of a group under min_group join their language's other small groups, then those of
    all languages; if those are too few as well, d2 is null and the row is kept. Null language or source: a group of its own.
    Null or empty text: no words, so base_failed. Repeated rows are each judged, alike. No rows in, no rows out."""
    with passing(docs.sparkSession) as made:
        return _quality_rules(made, docs, min_words, max_repeat_percent, min_group, tail, id_col, text_col, lang_col, source_col, keep)


def _quality_rules(made, docs, min_words, max_repeat_percent, min_group, tail, id_col, text_col, lang_col, source_col, keep) -> DataFrame:
    tag = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(c).cast("string")))
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(*keep).alias("_keep") if keep else F.lit(0).alias("_keep"), tag(lang_col).alias("_lang"), tag(source_col).alias("_source"), text_statistics(F.col(text_col)).alias("s"))
    rows = rows.select("_id", "_keep", "_lang", "_source", "s.w.*", "s.word_chars", "s.n_symbols", "s.l.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = kept(cut(rows.withColumn("base_failed", failed).withColumns(features()), "quality-statistics"), made)
    judged = rows.filter(~F.col("base_failed"))
    names = list(FEATURES)
    groups = judged.groupBy("_lang", "_source").count()
    # Each small group joins the next wider one: its language's, then the one of all.
    groups = groups.withColumn("_group", F.when(F.col("count") >= min_group, F.to_json(F.struct("_lang", "_source"))))
    for wider in (F.to_json(F.struct("_lang")), F.lit("{}")):
        groups = cut(groups, "quality-groups")
        small = groups.filter("_group is null").groupBy(wider.alias("_wider")).agg(F.sum("count").alias("_all")).filter(F.col("_all") >= min_group).select("_wider")
        groups = groups.withColumn("_key", wider).join(small, F.col("_key") == F.col("_wider"), "left").withColumn("_group", F.coalesce("_group", "_wider")).drop("_key", "_wider")
    groups = kept(cut(groups.filter("_group is not null").select("_lang", "_source", "_group"), "quality-groups"), made)
    rows = join_counted(rows, groups, ["_lang", "_source"])
    grouped = cut(rows.filter(~F.col("base_failed") & F.col("_group").isNotNull()).select("_group", *names), "quality-features")
    fits = kept(mcd_fits(grouped, names), made)
    out = with_distance(rows, fits, names, ["_id", "_keep", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    d2 = F.when(~F.col("base_failed"), F.col("_d2"))
    fine = ~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= chi2_quantile(len(names), 1 - tail))
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", d2.alias("d2"), fine.alias("kept"), *[F.col(f"_keep.{c}").alias(c) for c in keep])
