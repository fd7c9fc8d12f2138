"""Approximate nearest neighbours by balanced posting lists."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, drop, join_counted, ship

#: The index is fitted on this many distinct directions at most, and so is each list that is split; every vector is indexed.
SAMPLE, MAX_LISTS = 20_000, 2_048
#: A list of more entries is split into lists of about an eighth of that.
SPLIT = 4_096
#: Vectors and queries that meet in one task at most.
PART = 2_048


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 7, steps: int = 8) -> np.ndarray:
    """Unit centroids of balanced clusters: k-means whose distances grow with a cluster's excess over the mean size."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), lists, replace=False)].astype(np.float64)
    load = np.zeros(lists)
    for _ in range(steps):
        own = np.concatenate([(x @ at.T - 0.02 * load).argmax(1) for x in np.array_split(sample, math.ceil(len(sample) / 4096))])
        size = np.bincount(own, minlength=lists)
        load = 0.5 * load + np.maximum(0, size / size.mean() - 1.5)
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        empty = size == 0
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        at = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return at


class CentroidGraph:
    """Centroids linked to their nearest neighbours, searched best-first from a few entries, many queries at once."""

    def __init__(self, at: np.ndarray, degree: int = 16):
        self.at, k = at, len(at)
        self.links = np.empty((k, min(degree, max(1, k - 1))), np.int64)
        for rows in np.array_split(np.arange(k), math.ceil(k / 1024)):
            near = at[rows] @ at.T
            near[np.arange(len(rows)), rows] = -2
            self.links[rows] = np.argsort(-near, axis=1, kind="stable")[:, : self.links.shape[1]] if k > 1 else 0
        self.entries = np.unique(np.linspace(0, k - 1, min(k, max(16, int(4 * math.sqrt(k))))).astype(np.int64))

    def search(self, x: np.ndarray, want: int, beam: int = 48, hops: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """For unit rows x: ids and similarities of about the `want` nearest centroids, nearest first."""
        beam = max(beam, want)
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        ids, near = self._best(ids, x @ self.at[self.entries].T, beam)
        for _ in range(hops):
            more = self.links[ids[:, : max(8, want // 2)]].reshape(len(x), -1)
            new = np.concatenate([ids, more], axis=1)
            sims = np.concatenate([near, np.einsum("qd,qnd->qn", x, self.at[more])], axis=1)
            kept, near2 = self._best(new, sims, beam)
            if kept.shape == ids.shape and (kept == ids).all():
                break
            ids, near = kept, near2
        return ids[:, :want], near[:, :want]

    @staticmethod
    def _best(ids: np.ndarray, sims: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(ids, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1).copy()
        sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -3  # each centroid once
        order = np.argsort(-sims, axis=1, kind="stable")[:, :n]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return ids, sims


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, q, v: list of doubles) -> (id, q, dim, c, u): the vector as bytes and a hash of its direction. Vectors are divided by
    a power of two near their largest component, which changes no digit, so no norm over- or underflows. What is not a valid
    vector is left out."""
    for b in batches:
        ids, asks, v = b.columns
        lens = pc.fill_null(pc.list_value_length(v), 0).to_numpy()
        flat, first = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lens) - lens
        for dim in np.unique(lens[lens > 0]):
            rows = np.nonzero(lens == dim)[0]
            x = flat[first[rows][:, None] + np.arange(dim)]
            big = np.abs(x).max(axis=1)
            ok = np.isfinite(x).all(axis=1) & (big > 0)
            x = np.ldexp(x[ok], -np.frexp(big[ok])[1][:, None])
            c = [xxhash.xxh3_128_hexdigest(r.tobytes()) for r in x / np.abs(x).max(axis=1)[:, None] + 0.0]
            rows = pa.array(rows[ok])
            cols = [ids.take(rows), asks.take(rows), pa.array(np.full(len(c), dim, np.int32)), pa.array(c, pa.string()), pa.array([r.tobytes() for r in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "q", "dim", "c", "u"])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _raw(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _matrix(column: pd.Series) -> np.ndarray:
    """The vectors' directions."""
    x = _raw(column)
    return x / norms(x)[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x with each of y. Products come before the division, so where sums are exact equal cosines are equal doubles."""
    return np.clip((x @ y.T) / (norms(x)[:, None] * norms(y)), -1, 1)


def _chosen(ids: np.ndarray, sims: np.ndarray, ratio: float, least: int) -> np.ndarray:
    """Distance-ratio pruning: lists no farther than ratio times the nearest one, and the `least` nearest in any case."""
    far = np.sqrt(np.maximum(0, 2 - 2 * sims))
    keep = (far <= ratio * far[:, :1] + 1e-12) & (sims > -1.5)
    keep[:, :least] |= sims[:, :least] > -1.5
    return keep


def _dealt(graph: CentroidGraph, part: pd.DataFrame, want: int, ratio: float, least: int, name: str) -> pd.DataFrame:
    """Rows of part, each once for every list that it is dealt to, as column `name`."""
    out = []
    for some in (part.iloc[i : i + 256] for i in range(0, len(part), 256)):
        ids, sims = graph.search(_matrix(some["u"]), min(want, len(graph.at)))
        row, col = np.nonzero(_chosen(ids, sims, ratio, least))
        out.append(some.iloc[row].assign(**{name: ids[row, col]}))
    return pd.concat(out) if out else part.assign(**{name: np.zeros(0, np.int64)})


def lists_for(n: int) -> int:
    """Lists of n vectors: they grow with the square root of n, up to MAX_LISTS, beyond which lists are split."""
    return max(1, min(MAX_LISTS, round(1.7 * math.sqrt(n))))


def nearest_vectors(vectors: DataFrame, is_query: Column, k: int = 5, replicas: int = 5, replica_ratio: float = 1.20, probes: int = 48, probe_ratio: float = 1.6, least_probes: int = 24, share: float = 0.2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that is_query holds for, its k nearest other rows: query_id, rank (from 1), vec_id, score (cosine).

    Vectors that are null or zero, or hold null or non-finite components, take no part, nor do null ids. Shorter vectors are
    filled up with zeros to the longest one's length. Scores are doubles and ordered as such; where they are equal, smaller ids
    come first. Copies and scaled copies, whose quotients by their largest component are equal, are one class with its k + 1
    smallest ids that scores as the vector of the smallest one, so a third of the table in one direction costs as much as one row.

    Classes are assigned to the posting lists of near centroids (several, if the next is within replica_ratio of the nearest)
    by a search of the centroid graph, in memory and of bounded size. A list with more than SPLIT entries gets centroids of its
    own, fitted where its entries are, and is split by them alike, so lists stay short at any size. A query class reads the
    lists that probe_ratio leaves, least_probes at least and probes at most, but no more than `share` of all (or two). Lists
    and their queries are dealt out in parts of PART.

    Rows that repeat id and vector count once; an id with several vectors may be found by any of them and asks with each, but
    a query never finds its own id. A table without two valid vectors gives no rows. Other columns are not read."""
    spark = ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = cut(rows.filter("id is not null and v is not null").mapInArrow(units, "id long, q boolean, dim int, c string, u binary"), "ann-vectors")
    shortest, longest = rows.agg(F.min("dim"), F.max("dim")).first()
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = rows if shortest == longest else rows.withColumn("u", F.expr(f"rpad(u, {8 * longest}, X'00')"))
    by = Window.partitionBy("c").orderBy("id")
    ids = valid.select("c", "id").distinct().withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= k + 1)
    ids = ids.groupBy("c").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = cut(valid.groupBy("c").agg(F.min_by("u", "id").alias("u")).join(ids, "c"), "ann-classes")
    asked = cut(valid.filter("q").select("c", F.col("id").alias("query_id")).distinct(), "ann-queries")
    n = classes.count()
    within = int(min(1.0, SAMPLE / max(1, n)) * (1 << 20)) + 1
    sample = classes.select("c", "u").filter(F.pmod(F.xxhash64("c", F.lit(5)), F.lit(1 << 20)) < within).orderBy("c").limit(SAMPLE).toPandas()
    fitted = _matrix(sample["u"])
    lists = max(1, min(lists_for(n), len(fitted) // 8))
    graph = spark.sparkContext.broadcast(CentroidGraph(fit_centroids(fitted, lists)))
    read = lambda k_: max(2, min(probes, int(share * k_)))

    def dealt(seeking: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            how = (read(lists), probe_ratio, min(least_probes, read(lists))) if seeking else (replicas, replica_ratio, 1)
            for b in batches:
                yield _dealt(graph.value, b, *how, "list")[["list", "first", "c", "u"]]

        return run

    kind = "list long, first long, c string, u binary"
    told = classes.select(F.get("ids", F.lit(0)).alias("first"), "c", "u")
    posted = cut(told.mapInPandas(dealt(False), kind), "ann-lists")
    seekers = told.join(asked.select("c").distinct(), "c", "left_semi")
    probed = cut(seekers.mapInPandas(dealt(True), kind), "ann-probes")
    posted, probed, dropped = _split(posted, probed, lambda k_: (read(k_), probe_ratio, min(least_probes, read(k_))), (replicas, replica_ratio, 1))
    drop(rows)

    keys = ["list", "sub"]
    parts = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias(name))
    split = cut(parts(posted, "_np").join(parts(probed, "_nq"), keys), "ann-parts")
    each = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    part = lambda m: F.pmod(F.xxhash64("c"), F.col(m)).cast("int")
    held = join_counted(posted, split, keys, "inner").select(*keys, part("_np").alias("p"), each(F.col("_nq")).alias("q"), "first", "c", "u")
    seek = join_counted(probed, split, keys, "inner").select(*keys, each(F.col("_np")).alias("p"), part("_nq").alias("q"), "c", "u")

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"qc": [], "c": [], "score": []}
        if len(left) and len(right):
            left = left.sort_values("first", kind="stable")
            sims = cosines(_raw(right["u"]), _raw(left["u"]))
            # By score, then smallest id, as in the result: rows are put in order of ids, and the sort is stable.
            best = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * k + 2]
            q, c = np.repeat(np.arange(len(right)), best.shape[1]), best.ravel()
            out = {"qc": right["c"].to_numpy()[q], "c": left["c"].to_numpy()[c], "score": sims[q, c]}
        return pd.DataFrame(out)

    meet = [*keys, "p", "q"]
    found = held.groupBy(*meet).cogroup(seek.groupBy(*meet)).applyInPandas(scored, "qc string, c string, score double")
    found = cut(found.groupBy("qc", "c").agg(F.max("score").alias("score")), "ann-found")
    drop(split, *dropped)
    found = found.join(classes.select("c", F.explode("ids").alias("vec_id")), "c")
    best = Window.partitionBy("qc").orderBy(F.desc("score"), "vec_id")
    # An id with several vectors is found by the nearest of them.
    found = found.groupBy("qc", "vec_id").agg(F.max("score").alias("score"))
    found = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1)
    near = found.groupBy(F.col("qc").alias("c")).agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("near"))
    out = asked.join(near, "c").select("query_id", F.filter("near", lambda x: x["vec_id"] != F.col("query_id")).alias("near"))
    out = out.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _split(posted: DataFrame, probed: DataFrame, seek: object, post: tuple) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """posted and probed with `sub`, the list within the list: 0 in lists of SPLIT entries at most, else that of the nearest of
    the list's own centroids, which are fitted on at most SAMPLE of its entries. The third result is what can be dropped."""
    sized = posted.groupBy("list").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT)
    sized = cut(sized.withColumn("parts", F.ceil(F.col("n") / (8 * PART)).cast("int")), "ann-sizes")
    zero = F.lit(0).cast("long").alias("sub")
    if sized.isEmpty():
        return posted.select("*", zero), probed.select("*", zero), [sized, posted, probed]

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(part.sort_values("c").head(SAMPLE)["u"])
        k = max(1, min(MAX_LISTS, len(x) // 8, math.ceil(8 * part["n"].iloc[0] / SPLIT)))
        return pd.DataFrame({"list": [part["list"].iloc[0]], "m": [fit_centroids(x, k).tobytes()]})

    big = join_counted(posted, sized, "list", "inner")
    some = big.filter(F.pmod(F.xxhash64("c", F.lit(6)), F.lit(1 << 20)) < F.least(F.lit(1.0), F.lit(0.9 * SAMPLE) / F.col("n")) * (1 << 20))
    own = cut(some.select("list", "n", "c", "u").groupBy("list").applyInPandas(fitted, "list long, m binary"), "ann-sublists")

    def placed(seeking: bool):
        def run(part: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
            if not len(part) or not len(at):
                return pd.DataFrame({c: [] for c in ("list", "first", "c", "u", "sub")})
            m = np.frombuffer(at["m"].iloc[0], np.float64).reshape(-1, len(part["u"].iloc[0]) // 8)
            return _dealt(CentroidGraph(m), part, *(seek(len(m)) if seeking else post), "sub")[["list", "first", "c", "u", "sub"]]

        return run

    def dealt(rows: DataFrame, seeking: bool, name: str) -> DataFrame:
        keyed = join_counted(rows, sized, "list").withColumn("p", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
        near = own.join(sized, "list").select("list", "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
        split = keyed.filter("n is not null").select("list", "first", "c", "u", "p").groupBy("list", "p").cogroup(near.groupBy("list", "p"))
        out = split.applyInPandas(placed(seeking), "list long, first long, c string, u binary, sub long")
        return cut(keyed.filter("n is null").select("list", "first", "c", "u", zero).unionByName(out), name)

    out = dealt(posted, False, "ann-lists"), dealt(probed, True, "ann-probes")
    return *out, [sized, own, posted, probed, *out]
