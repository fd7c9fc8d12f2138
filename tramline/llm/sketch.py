"""Corpus-wide counts in arrays of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame

from .textblocks import Words, arrow_rows, blocks

#: An array travels in so many pieces, so that its sums are shared out.
PIECES = 64


def summed(docs: DataFrame, text: Column, size: int, update: Callable[[np.ndarray, Words], None], lower: bool = False, kind: type = np.uint64) -> np.ndarray:
    """Sum over all tasks of the array that update() counts into for each group of texts; counts stop at kind's largest value.

    Each task sends its array once, compressed; pieces of it are summed one after another where Spark brings them together. The
    result, of `size` counts whatever the corpus, is all that reaches the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size, kind)
        for _, _, words in blocks(((None, t) for (t,) in arrow_rows(batches)), lower=lower):
            update(acc, words)
        parts = acc.reshape(PIECES, -1)
        for i in np.nonzero(parts.any(axis=1))[0]:
            yield _sent(i, parts[i])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for piece, data in arrow_rows(batches):
            more = _received(data, kind)
            have = acc.setdefault(piece, np.zeros(len(more), kind))
            acc[piece] = np.where(have > np.iinfo(kind).max - more, np.iinfo(kind).max, have + more).astype(kind)
        for piece, part in acc.items():
            yield _sent(piece, part)

    parts = docs.select(text.cast("binary").alias("text")).mapInArrow(counted, "piece int, data binary")
    rows = parts.repartition(PIECES, "piece").mapInArrow(totals, "piece int, data binary").collect()
    out = np.zeros((PIECES, size // PIECES), kind)
    for row in rows:
        out[row["piece"]] = _received(row["data"], kind)
    return out.ravel()


def _sent(piece: int, counts: np.ndarray) -> pa.RecordBatch:
    """Byte by byte, so that the high bytes, mostly 0, take no room."""
    data = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.view(np.uint8).reshape(len(counts), -1).T).tobytes())
    return pa.RecordBatch.from_pydict({"piece": pa.array([int(piece)], pa.int32()), "data": pa.array([data], pa.binary())})


def _received(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()
