"""Codes of vectors' parts from codebooks kept by Lloyd's steps on differences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, drop, join_counted, ship

#: Components become floor(SCALE * x).
SCALE = 256
#: Whole numbers below this are exact as doubles, and so are their products and sums as long as they stay below it.
EXACT = 1 << 53
LONG = (1 << 63) - 1
STATE = "vec_id long, label string, v binary, was binary, code binary"
DELTA = "part int, entry int, n long, sums array<string>"


class Codebooks(NamedTuple):
    """entries: whole numbers [part][entry][component] as Python ints; sums and counts: the running sums of the parts assigned."""

    entries: np.ndarray
    sums: np.ndarray
    counts: np.ndarray


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, v: list of doubles) -> (vec_id, label, v: floor(SCALE * x), see packed()). Rows with a null vector, or a
    null or non-finite component, are left out."""
    for b in batches:
        ids, labels, vectors = b.columns
        flat = vectors.flatten()
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0
        sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x) | flat.is_null().to_numpy(zero_copy_only=False))])
        ok = (bad[bounds[1:]] == bad[bounds[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
        rows = np.nonzero(ok)[0]
        data = pa.array([packed(x[bounds[k] : bounds[k + 1]]) for k in rows], pa.binary())
        none = pa.nulls(len(rows), pa.binary())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), labels.take(pa.array(rows)), data, none, none], ["vec_id", "label", "v", "was", "code"])


def packed(x: np.ndarray) -> bytes:
    """Whole numbers given as doubles, which hold them exactly: the bytes of each, 2 or 8, and then all."""
    return b"\x02" + x.astype("<i2").tobytes() if np.abs(x).max(initial=0) < 1 << 15 else b"\x08" + x.tobytes()


def matrix(column: list[bytes], parts: int, width: int) -> np.ndarray:
    """packed() vectors as [part][vector][component], filled up with zeros to parts * width components."""
    out = np.zeros((len(column), parts * width))
    kinds = {2: "<i2", 8: "<f8"}
    if len({(len(data), data[0]) for data in column}) == 1:
        raw = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
        x = np.ascontiguousarray(raw[:, 1:]).view(kinds[column[0][0]])
        out[:, : x.shape[1]] = x
    else:
        for k, data in enumerate(column):
            out[k, : len(data) // data[0]] = np.frombuffer(data, kinds[data[0]], offset=1)
    return out.reshape(len(column), parts, width).transpose(1, 0, 2)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest entry (of equal ones the first) and its squared distance, exactly: in doubles where no number that
    comes up reaches EXACT, else in Python's whole numbers."""
    top = max(np.abs(x).max(initial=0), float(max((abs(int(e)) for e in entries.ravel()), default=0)))
    if 4 * x.shape[1] * top * top < EXACT:
        e = entries.astype(np.float64)
        far = (x * x).sum(axis=1)[:, None] - 2 * (x @ e.T) + (e * e).sum(axis=1)
    else:
        x = np.array([[int(c) for c in row] for row in x], object).reshape(x.shape)
        far = np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)
    at = far.argmin(axis=1)
    return at.astype(np.uint8), far[np.arange(len(x)), at]


def first_books(rows: DataFrame, parts: int, size: int) -> tuple[Codebooks, int]:
    """Codebooks of the parts of the `size` vectors with the smallest ids, with no part assigned; and the components of a part."""
    longest = rows.agg(F.max(F.expr("octet_length(v) div CASE hex(substring(v, 1, 1)) WHEN '02' THEN 2 ELSE 8 END"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    some = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(size).collect()
    x = matrix([r["v"] for r in some], parts, width)
    entries = np.array([int(c) for c in x.ravel()], object).reshape(x.shape)
    return Codebooks(entries, np.zeros_like(entries), np.zeros(entries.shape[:2], object)), width


def assigned(rows: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """rows with each part's nearest entry as `code`, a byte a part; what was the code becomes `was`."""
    entries = rows.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["v"].to_pylist(), len(entries.value), width)
            codes = np.stack([nearest(part, e)[0] for part, e in zip(x, entries.value)], axis=1)
            code = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["v"], b["code"], code], ["vec_id", "label", "v", "was", "code"])

    return rows.mapInArrow(run, STATE)


def moved(rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """What the parts whose code is not what it was take from one entry's sum and give to another's: part, entry, n, sums. Each
    task adds up its own, so it sends a row for each entry that any of its parts left or joined, and none for what stayed."""
    parts, size, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * size, width), object), np.zeros(parts * size, np.int64)
        for b in batches:
            x = matrix(b["v"].to_pylist(), parts, width)
            new = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(-1, parts)
            was = np.array([np.frombuffer(w, np.uint8) if w is not None else np.full(parts, -1) for w in b["was"].to_pylist()], np.int64).reshape(-1, parts)
            for code, sign in ((new.astype(np.int64), 1), (was, -1)):
                row, part = np.nonzero((new != was) & (code >= 0))
                at, values = part * size + code[row, part], x[part, row]
                counts += sign * np.bincount(at, minlength=parts * size)
                if len(at) and len(at) * float(np.abs(values).max()) < EXACT:
                    own = np.stack([np.bincount(at, values[:, c], parts * size) for c in range(width)], axis=1)
                    hit = np.unique(at)
                    sums[hit] += sign * np.array([[int(c) for c in r] for r in own[hit]], object)
                else:
                    for k, v in zip(at, values):
                        sums[k] += sign * np.array([int(c) for c in v], object)
        hit = np.nonzero((counts != 0) | (sums != 0).any(axis=1))[0]
        yield pa.RecordBatch.from_pydict({"part": pa.array(hit // size, pa.int32()), "entry": pa.array(hit % size, pa.int32()), "n": pa.array(counts[hit], pa.int64()), "sums": pa.array([[str(c) for c in r] for r in sums[hit]], pa.list_(pa.string()))})

    def total(some: pd.DataFrame) -> pd.DataFrame:
        sums = [str(sum(map(int, column))) for column in zip(*some["sums"])]
        return pd.DataFrame({"part": some["part"].iloc[:1], "entry": some["entry"].iloc[:1], "n": [int(some["n"].sum())], "sums": [sums]})

    changed = rows.filter(~F.col("code").eqNullSafe(F.col("was"))).select("v", "was", "code")
    return changed.mapInArrow(run, DELTA).groupBy("part", "entry").applyInPandas(total, DELTA)


def updated(books: Codebooks, deltas: DataFrame) -> Codebooks:
    """Codebooks after the deltas, of which there is one for each entry at most: an entry becomes floor(sum / count) of the parts
    assigned to it; one without parts stays."""
    sums, counts, entries = books.sums.copy(), books.counts.copy(), books.entries.copy()
    for r in deltas.collect():
        sums[r["part"], r["entry"]] += np.array([int(c) for c in r["sums"]], object)
        counts[r["part"], r["entry"]] += r["n"]
    used = counts > 0
    entries[used] = sums[used] // counts[used][:, None]
    return Codebooks(entries, sums, counts)


def coded_vectors(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each vector that is kept: id, code (two hex digits a part), error (long), label_error (long),
    codebooks_sha256.

    Vectors that are null or hold a null or non-finite component are left out. Components become floor(256 * x); vectors are cut
    into `parts` equal consecutive parts, each with a codebook that begins as that part of the `size` smallest ids (at most 256). A round assigns
    every part to its nearest entry (squared distance, ties to the lower index) and moves each entry to floor(mean); entries
    without parts stay. All is whole numbers, so the result does not depend on how Spark deals the rows out.

    Codes and the sums of what is assigned to each entry are kept from round to round: codes in a written table beside the
    vectors, with the codes before them, sums with the codebooks (parts * size * width numbers on the driver, whatever the
    table). A round shuffles only what parts that changed their entry take from one sum and give to another, added up in each
    task. A lost executor costs a reread of the last written codes.

    Vectors shorter than the longest kept one are filled up with zeros, as is its length to a multiple of `parts`. With fewer
    than `size` vectors, codebooks are as small as that. Null ids come last, equal ids in order of their vectors' bytes. Rows
    that repeat an id are coded each for itself. Sums over 2^63 - 1 are given as that. No rows in, no rows out."""
    spark = ship(vectors.sparkSession)
    kinds = dict(vectors.dtypes)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = cut(rows.filter("v is not null").mapInArrow(whole, STATE), "codes")
    books, width = first_books(rows, parts, size)
    shape = books.entries.shape
    for n in range(rounds + 1):
        if not shape[1]:
            break
        before, rows = rows, cut(assigned(rows, books, width), "codes")
        drop(before)
        if n < rounds:
            books = updated(books, moved(rows, shape))
    entries = spark.sparkContext.broadcast(books.entries)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["v"].to_pylist(), parts, width)
            codes = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(-1, parts)
            far = [0] * len(codes)
            for k, (part, e) in enumerate(zip(x, entries.value)):
                for i, d in enumerate(distances(part, e[codes[:, k]])):
                    far[i] += d
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([min(LONG, d) for d in far], pa.int64())], ["vec_id", "label", "code", "error"])

    out = cut(rows.mapInArrow(measured, "vec_id long, label string, code string, error long"), "coded")
    drop(rows)
    by = out.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long").alias("label_error"))
    by = cut(by.withColumnRenamed("label", "_label"), "label-errors")
    sha = hashlib.sha256(",".join(str(c) for c in books.entries.ravel()).encode()).hexdigest()
    out = join_counted(out, by, F.col("label").eqNullSafe(F.col("_label")), "inner")
    return out.select(F.col("vec_id").cast(kinds[id_col]).alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def distances(x: np.ndarray, e: np.ndarray) -> Iterable[int]:
    """Squared distances of rows of x from rows of e, exactly."""
    top = max(np.abs(x).max(initial=0), float(max((abs(int(c)) for c in e.ravel()), default=0)))
    if 4 * x.shape[1] * top * top < EXACT:
        return ((x - e.astype(np.float64)) ** 2).sum(axis=1).astype(np.int64).tolist()
    return [sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r, s in zip(x, e)]


def _round(n: int) -> str:
    """Assignments a{n} by codebooks c{n}, then codebooks c{n+1}."""
    return f"""
     f{n} AS (SELECT x.k, x.part, c.entry, sum((x.i - c.i) * (x.i - c.i))::BIGINT AS d FROM x JOIN c{n} c USING (part, pos) GROUP BY ALL),
     a{n} AS (SELECT k, part, min(struct_pack(d := d, e := entry)) AS b FROM f{n} GROUP BY ALL),
     m{n} AS (SELECT x.part, a.b.e AS entry, x.pos, sum(x.i) AS s, count(*) AS n FROM x JOIN a{n} a USING (k, part) GROUP BY ALL),
     c{n + 1} AS (SELECT c.part, c.entry, c.pos, coalesce(((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT, c.i) AS i FROM c{n} c LEFT JOIN m{n} m USING (part, entry, pos)),"""


#: For vectors of one length, a multiple of 16.
ORACLE = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS k, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v, len(embedding) // 16 AS w
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
     u AS (SELECT k, unnest(v) AS i, generate_subscripts(v, 1) - 1 AS p, w FROM v),
     x AS (SELECT k, p // w AS part, p % w AS pos, i FROM u),
     c0 AS (SELECT part, k AS entry, pos, i FROM x WHERE k < 64),{_round(0)}{_round(1)}{_round(2)}
     r AS (SELECT k, string_agg(printf('%02x', b.e), '' ORDER BY part) AS code, sum(b.d)::BIGINT AS error FROM a2 GROUP BY ALL),
     h AS (SELECT sha256(string_agg(i::VARCHAR, ',' ORDER BY part, entry, pos)) AS h FROM c2)
SELECT v.vec_id, r.code, r.error, sum(r.error) OVER (PARTITION BY v.label)::BIGINT AS label_error, h.h AS codebooks_sha256 FROM v JOIN r USING (k) CROSS JOIN h
"""
