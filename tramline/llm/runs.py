"""Maximal periodic runs of words, by a suffix tree whose smaller halves are traversed."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ship
from .textblocks import arrow_rows

#: Words of texts that are searched together; a longer text is searched alone.
TOGETHER = 1 << 17
OUT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class SuffixTree:
    """The suffix tree of some word sequences, as its leaves in order and the depths between neighbours.

    key: a number for each word, no number in two sequences; first, end: the sequence's bounds for each place. ranks[j] is equal
    at two places if and only if the 2**j words from there are equal, which compares stretches of any length in a few steps."""

    def __init__(self, key: np.ndarray, first: np.ndarray, end: np.ndarray):
        self.first, self.end, n = first, end, len(key)
        leaves = np.argsort(key, kind="stable")
        new = np.ones(n + 1, bool)
        new[1:n] = key[leaves[1:]] != key[leaves[:-1]]
        rank = np.empty(n, np.int64)
        rank[leaves] = np.maximum.accumulate(np.where(new[:n], np.arange(n), 0))
        self.ranks, step = [rank.astype(np.int32)], 1
        while len(slots := np.nonzero(~(new[:n] & new[1:]))[0]):
            # Only what is still tied is sorted, by what follows `step` words later.
            at = leaves[slots]
            after = at + step
            second = np.where(after < end[at], rank[np.minimum(after, n - 1)] + 1, 0)
            both = rank[at] * (n + 1) + second
            order = np.argsort(both, kind="stable")
            leaves[slots], both = at[order], both[order]
            new[slots[1:]] = both[1:] != both[:-1]
            rank[leaves[slots]] = np.maximum.accumulate(np.where(new[slots], slots, 0))
            self.ranks.append(rank.astype(np.int32))
            step *= 2
        self.leaves, self.rank = leaves, rank

    def alike(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from places a and b on (or, back, before them) are equal; a pair lies in one sequence."""
        out = np.zeros(len(a), np.int64)
        first, end = self.first[a], self.end[a]
        for j in reversed(range(len(self.ranks))):
            size = 1 << j
            x, y = (a - out - size, b - out - size) if back else (a + out, b + out)
            ok = np.nonzero((np.minimum(x, y) >= first) & (np.maximum(x, y) < end))[0]
            ok = ok[self.ranks[j][x[ok]] == self.ranks[j][y[ok]]]
            out[ok] += size
        return out

    def nodes(self) -> tuple[np.ndarray, ...]:
        """Inner nodes below the root: depth, and the leaves' range [left, middle) and [middle, right) of the two halves. A node
        with more children is as many nodes of two halves, one above the other."""
        n = len(self.leaves)
        depth = np.full(n + 1, -1, np.int64)
        depth[1:n] = 0
        one = self.ranks[0][self.leaves]
        same = np.nonzero(one[1:] == one[:-1])[0]
        depth[same + 1] = self.alike(self.leaves[same], self.leaves[same + 1])
        middle = same + 1
        left, right = np.arange(n + 1) - 1, np.arange(n + 1) + 1
        todo = middle
        while len(todo := todo[depth[left[todo]] >= depth[todo]]):
            left[todo] = left[left[todo]]
        todo = middle
        while len(todo := todo[depth[right[todo]] > depth[todo]]):
            right[todo] = right[right[todo]]
        return depth[middle], left[middle], middle, right[middle]

    def branching(self, times: int) -> tuple[np.ndarray, np.ndarray]:
        """Branching tandem repeats: place and period d of each pair of equal stretches of d words, one after the other, that are
        followed by different words. Of each node the smaller half's leaves are asked for the leaf d words away in the other.
        Periods of which `times` do not fit into the sequence are left out."""
        depth, left, middle, right = self.nodes()
        fits = depth * times <= (self.end - self.first)[self.leaves[middle]]
        depth, left, middle, right = (x[fits] for x in (depth, left, middle, right))
        small = middle - left <= right - middle
        low, size = np.where(small, left, middle), np.where(small, middle - left, right - middle)
        other_low, other_high = np.where(small, middle, left), np.where(small, right, middle)
        node = np.repeat(np.arange(len(depth)), size)
        leaf = self.leaves[np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + low[node]]
        places, periods = [], []
        for sign in (1, -1):
            there = leaf + sign * depth[node]
            ok = np.nonzero((there >= self.first[leaf]) & (there < self.end[leaf]))[0]
            rank = self.rank[there[ok]]
            ok = ok[(rank >= other_low[node[ok]]) & (rank < other_high[node[ok]])]
            places.append(np.minimum(leaf[ok], there[ok]))
            periods.append(depth[node[ok]])
        return np.concatenate(places), np.concatenate(periods)


def maximal_runs(sequences: list[np.ndarray], times: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each sequence of small whole numbers, by start, then period.

    A run ends where a branching tandem repeat ends; turning the repeat to the left for as long as the words agree brings it to
    its start. Repeats of one stretch are merged into the one of the least period."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    if not bounds[-1]:
        return out
    spread = np.cumsum([0] + [int(s.max()) + 1 if len(s) else 0 for s in sequences])
    doc = np.repeat(np.arange(len(sequences)), sizes)
    tree = SuffixTree(np.concatenate(sequences) + spread[doc], bounds[doc], bounds[doc + 1])
    at, period = tree.branching(times)
    start, end = at - tree.alike(at, at + period, back=True), at + 2 * period
    ok = end - start >= np.maximum(least, times * period)
    start, end, period = start[ok], end[ok], period[ok]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    for s, e, p in zip(start[order].tolist(), end[order].tolist(), period[order].tolist()):
        d = doc[s]
        out[d].append((s - int(bounds[d]), e - s, p))
    return out


def repeating(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place where a document's tail is made to repeat, None where it is not: the case that op11's
    contract plants by the checksum of the id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def word_runs(docs: DataFrame, times: int = 4, least: int = 6, arrange=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, runs (start, length, period in words; by start, then period), collapsed (the
    text's words without those that a run holds after its first period, joined by one space).

    A run is a stretch of words with smallest period q, of max(least, times * q) words or more, that cannot be made longer
    either way; times is 2 at least. arrange(id, n): places of the words to be taken instead of a text's own, or None.

    Runs do not cross documents, so each task searches its own texts where it reads them, and nothing is shuffled. Texts are
    searched TOGETHER words at a time; a text takes some 100 bytes a word, and 4 more for each doubling of its longest repeat.

    Null or empty text, or one without words: no run, an empty text. Null ids pass through and are arranged as None; rows that
    repeat an id are searched each for itself; overlapping runs are all given. Other columns are not read."""
    if times < 2:
        raise ValueError("a run has two periods or more")
    spark = ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        held = 0
        for i, text in arrow_rows(batches):
            words = text.split()  # of bytes: at space, tab, line feed, vertical tab, form feed, carriage return
            at = arrange(i, len(words)) if arrange else None
            codes: dict[bytes, int] = {}
            keys = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
            if held and held + len(words) > TOGETHER:
                yield answered(group)
                group, held = [], 0
            group.append((i, words, keys if at is None else keys[at], at))
            held += len(words)
        if group:
            yield answered(group)

    def answered(group: list[tuple]) -> pa.RecordBatch:
        found, collapsed = maximal_runs([keys for _, _, keys, _ in group], times, least), []
        for (_, words, keys, at), runs in zip(group, found):
            kept = np.arange(len(words)) if at is None else at
            if runs:
                edge = np.zeros(len(words) + 1, np.int64)
                for s, size, p in runs:
                    edge[s + p] += 1
                    edge[s + size] -= 1
                kept = kept[np.cumsum(edge[:-1]) == 0]
            collapsed.append(b" ".join(words if at is None and not runs else [words[k] for k in kept.tolist()]).decode())
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], pa.list_(run))
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in group], pa.int64()), pa.array([len(g[1]) for g in group], pa.int64()), runs, pa.array(collapsed, pa.string())], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    out = rows.mapInArrow(searched, f"id long, {OUT}")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of word_runs(): the number of runs, the run of the greatest length / period (of equal ones the first
    by start, then period), and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    stronger = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    rows = found.withColumn("_best", F.aggregate("runs", F.get("runs", F.lit(0)), stronger))
    best = F.col("_best")
    milli = F.floor(1000 * best["length"] / best["period"])
    listed = F.array_join(F.transform("runs", line), "")
    return rows.select(id_col, F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")], milli.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
