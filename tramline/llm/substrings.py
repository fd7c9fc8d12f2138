"""Substring deduplication by fixed-block anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, drop, ship, word_count
from .textblocks import arrow_rows, blocks

#: Entries of a hash part, and words of a bucket of documents, about; parts and buckets at least; bytes of texts packed together.
PART_ENTRIES, BUCKET_WORDS, LEAST, TEXTS = 1 << 20, 300_000, 48, 4 << 20
PACKED = "part int, n int, data binary"
NULL_ID = -(1 << 63)


def packed(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """Entries as one compressed row for each part they belong to. The last three columns, a place (document, row key,
    position), are sent as differences, and every column byte by byte, which brings a place to about two bytes."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    edges = np.concatenate([[0], np.nonzero(part[1:] != part[:-1])[0] + 1, [len(part)]]) if len(part) else [0]
    press = zstandard.ZstdCompressor(level=1)
    for a, b in zip(edges[:-1], edges[1:]):
        sent = [np.diff(c[a:b], prepend=c.dtype.type(0)) if k >= len(columns) - 3 else c[a:b] for k, c in enumerate(columns)]
        yield int(part[a]), int(b - a), press.compress(b"".join(c.view(np.uint8).reshape(b - a, -1).T.tobytes() for c in sent))


def unpacked(rows: list[tuple[int, bytes]], kinds: list) -> list[np.ndarray]:
    """The columns of all rows of a part, joined."""
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for n, data in rows:
        raw, at = zstandard.ZstdDecompressor().decompress(data), 0
        for k, kind in enumerate(kinds):
            size = n * np.dtype(kind).itemsize
            column = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(-1, n).T).view(kind).ravel()
            out[k].append(np.cumsum(column, dtype=kind) if k >= len(kinds) - 3 else column)
            at += size
    return [np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(out, kinds)]


#: Anchor entries: 48 bits of the block hash beside the part's own, then id, 64 bits of hash of id and text, place.
ANCHOR = [np.uint32, np.uint16, np.int64, np.int64, np.uint32]
WINDOW = [np.uint64, np.uint32, np.int64, np.int64, np.uint32]
PLACE = [np.int64, np.int64, np.uint32]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, n, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], ["part", "n", "data"])


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _rows(table: pa.Table) -> list[tuple[int, bytes]]:
    return list(zip(table["n"].to_pylist(), table["data"].to_pylist()))


def _by_row(doc: np.ndarray, key: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    order = np.lexsort((at, key, doc))
    doc, key, at = doc[order], key[order], at[order]
    edges = np.nonzero((doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))[0] + 1
    return {(int(d[0]), int(k[0])): a for d, k, a in zip(np.split(doc, edges), np.split(key, edges), np.split(at, edges)) if len(d)}


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: which begin a run of equal ones, and which are in a run of two or more."""
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return new, ~(new & np.append(new[1:], True)) if len(key) else new


def _repeats(h: np.ndarray, h1: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which entries have an equal hash at an earlier place."""
    order = np.lexsort((at, doc, h1, h))
    h, h1, doc, at = (x[order] for x in (h, h1, doc, at))
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (h1[1:] != h1[:-1])]) if len(h) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
    out = np.zeros(len(h), bool)
    out[order] = (doc != doc[first]) | (at != at[first])
    return out


def _settled(table: pa.Table, parts: int) -> pa.Table:
    """Rows that were decided before the shuffle, by their bucket."""
    return _table([(p - parts, n, d) for p, n, d in zip(table["part"].to_pylist(), table["n"].to_pylist(), table["data"].to_pylist())])


def repeated_spans(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, spans (array of from, to in words: the maximal repeats), kept (text).

    A window of `window` words is a repeat if its words also start earlier: in a smaller id, or earlier in the same document.
    Words that a repeat covers are removed; spans are the unions of such windows.

    1. Every document is cut into blocks of window // 2 words at fixed places: any window holds one of them whole. The blocks
       are the index, every rolling window of that many words probes it; both are sent, hashed and packed, to the hash's part.
       A block that something else equals is an anchor.
    2. Around its anchors a document's full windows are hashed to 96 bits and sent to their part. Equal windows lie within
       equal text, so both sides of a pair have an anchor in theirs. Of equal windows all but the earliest are repeats.
    3. Runs of repeats, brought back to their documents, extend to the maximal spans.
    Pairs are never formed. What repeats within one group of texts (TEXTS bytes, or a bucket) is settled there, and only its
    earliest place is sent on, so a passage that a third of all documents share brings one entry from each group to its part.
    Rows are known and dealt by 64 bits of hash of id and text, so rows of one id are spread, and nothing is collected.

    Ids are integers; null counts as smaller than all. Null or empty text: no words. Rows that repeat id and text are judged
    alike, each against earlier places. Of rows that repeat an id with other texts none is earlier than another: only a place
    further on is later. No rows in, no rows out. Other columns are not read."""
    spark = ship(docs.sparkSession)
    half = window // 2
    total = docs.agg(F.sum(word_count(F.col(text_col)))).first()[0] or 0
    parts, buckets = max(LEAST, total // PART_ENTRIES), max(LEAST, total // BUCKET_WORDS)
    ident, text = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(ident.alias("doc"), F.xxhash64(ident, text).alias("key"), text.alias("text"))
    dealt = rows.withColumn("part", F.pmod("key", F.lit(buckets)).cast("int"))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, words in blocks((((d, k), t) for d, k, t in arrow_rows(batches)), size=TEXTS):
            start, h = words.windows(half)
            part, rest, d = (h % np.uint64(parts)).astype(np.int64), h // np.uint64(parts), words.doc[start]
            low, high = (rest & np.uint64(0xFFFFFFFF)).astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint16)
            (doc, key), at = np.array(ids, np.int64)[d].T, words.at[start].astype(np.uint32)
            order = np.argsort(h, kind="stable")
            new, shared = _runs(h[order])
            sent, here = np.sort(order[new]), np.sort(order[shared])  # in order of place, which packs well
            here = here[at[here] % half == 0]
            found = list(packed(part[sent], [x[sent] for x in (low, high, doc, key, at)]))
            found += packed(parts + key[here] % buckets, [doc[here], key[here], at[here]])
            for i in range(0, len(found), 64):
                yield _batch(found[i : i + 64])

    def anchors(part: tuple, table: pa.Table) -> pa.Table:
        if part[0].as_py() >= parts:
            return _settled(table, parts)
        low, high, doc, key, at = unpacked(_rows(table), ANCHOR)
        h = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        order = np.argsort(h, kind="stable")
        some = np.sort(order[_runs(h[order])[1]])
        some = some[at[some] % half == 0]
        return _table(list(packed(key[some] % buckets, [doc[some], key[some], at[some]])))

    def windows(texts: pa.Table, found: pa.Table) -> pa.Table:
        places = _by_row(*unpacked(_rows(found), PLACE))
        out: list[tuple[int, int, bytes]] = []
        some = (((d, k), t) for d, k, t in zip(*(texts[c].to_pylist() for c in ("doc", "key", "text"))) if (d, k) in places)
        for ids, _, words in blocks(some, hashes=2, size=TEXTS):
            start, h = words.windows(window, 0)
            _, h1 = words.windows(window, 1)
            near = np.zeros(len(words.doc) + 1, np.int64)  # +1 where anchored windows begin, -1 after the last of them
            for k, row in enumerate(ids):
                at = places[row].astype(np.int64)
                near_from, near_to = words.first[k] + np.maximum(0, at - (window - half)), words.first[k] + at + 1
                np.add.at(near, near_from, 1)
                np.add.at(near, near_to, -1)
            pick = np.cumsum(near)[start] > 0
            start, h, h1 = start[pick], h[pick], h1[pick].astype(np.uint32)
            (doc, key), at = np.array(ids, np.int64)[words.doc[start]].T, words.at[start].astype(np.uint32)
            rep = _repeats(h, h1, doc, at)
            sent = ~rep
            out += packed((h[sent] % np.uint64(parts)).astype(np.int64), [x[sent] for x in (h, h1, doc, key, at)])
            out += packed(parts + key[rep] % buckets, [doc[rep], key[rep], at[rep]])
        return _table(out)

    def later(part: tuple, table: pa.Table) -> pa.Table:
        if part[0].as_py() >= parts:
            return _settled(table, parts)
        h, h1, doc, key, at = unpacked(_rows(table), WINDOW)
        rep = _repeats(h, h1, doc, at)
        return _table(list(packed(key[rep] % buckets, [doc[rep], key[rep], at[rep]])))

    def cleaned(texts: pa.Table, found: pa.Table) -> pa.Table:
        places = _by_row(*unpacked(_rows(found), PLACE))
        out: dict[str, list] = {k: [] for k in ("doc", "n_words", "n_removed", "spans", "kept")}
        for doc, key, text in zip(*(texts[c].to_pylist() for c in ("doc", "key", "text"))):
            words = text.split()  # of bytes, at exactly the six separators
            at = places.get((doc, key)) if places else None
            spans, kept = [], words
            if at is not None:
                at = np.unique(at.astype(np.int64))
                new = np.concatenate([[True], at[1:] > at[:-1] + window])
                a = at[new]
                b = np.append(at[:-1][new[1:]], at[-1]) + window
                spans = [{"from": int(x), "to": int(y)} for x, y in zip(a, b)]
                edges = [0, *(e for s in spans for e in (s["from"], s["to"])), len(words)]
                kept = [w for x, y in zip(edges[::2], edges[1::2]) for w in words[x:y]]
            out["doc"].append(doc)
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["spans"].append(spans)
            out["kept"].append(b" ".join(kept))
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        kinds = {"doc": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "spans": span, "kept": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    probed = rows.mapInArrow(probes, PACKED).groupBy("part").applyInArrow(anchors, PACKED)
    anchored = cut(probed, "repeat-anchors")
    full = dealt.groupBy("part").cogroup(anchored.groupBy("part")).applyInArrow(windows, PACKED)
    repeats = cut(full.groupBy("part").applyInArrow(later, PACKED), "repeat-windows")
    drop(anchored)
    out = dealt.groupBy("part").cogroup(repeats.groupBy("part")).applyInArrow(cleaned, "doc long, n_words long, n_removed long, spans array<struct<from:long,to:long>>, kept binary")
    back = F.when(F.col("doc") != NULL_ID, F.col("doc")).cast(dict(docs.dtypes)[id_col])
    return out.select(back.alias(id_col), "n_words", "n_removed", "spans", F.col("kept").cast("string").alias("kept"))


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
     v AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 19)) AS s, ws FROM w WHERE len(ws) >= 20),
     k AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS h FROM v),
     r AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM k) WHERE n > 1),
     c AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM r),
     g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id IS NOT DISTINCT FROM g.doc_id
"""
