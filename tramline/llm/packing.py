"""Lexical retrieval packing: windows of a seed document and its BM25 neighbours."""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ship
from .sketch import PIECES, summed
from .textblocks import Words, arrow_rows, blocks, mix
from .vectors import fit_centroids

#: Terms are words hashed into TERMS buckets, so document frequencies have a fixed size. Words of a shard, about.
TERMS, SHARD_WORDS = 1 << 18, 200_000
#: Documents that the topics are fitted on and topics at most; numbers of a document's sketch.
SAMPLE, MAX_TOPICS, SKETCH = 20_000, 2_048, 256
#: A key's bits: topic, second nearest topic, signs of projections, hash. Shards of a range of the order, about.
TOPIC_BITS, PLANES, HASH_BITS, PART_SHARDS = 12, 16, 22, 4
TOPIC_SHIFT = TOPIC_BITS + PLANES + HASH_BITS
#: Lists that hold more than this share of a shard's documents are scored as whole rows of weights.
COMMON, SEEDS = 1 / 8, 32
K1, B = 1.2, 0.75
#: What the byte-level pattern has for runs of white space before a word, and such runs.
LOOK_AHEAD, _SPACES = r"|\s+(?!\S)", re.compile("[\\t\\n\\r ]{2}")
#: Texts of these characters, without special strings, are split alike by both libraries; others go the exact way round.
_PLAIN, _ASCII = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\u024f]*"), b"\t\n\r" + bytes(range(0x20, 0x7F))


class Encoder:
    """Ids of a tokenizers file. ranks: the same vocabulary's ranks and pattern, by which plain texts are encoded faster."""

    def __init__(self, model: str, ranks: str | None, pattern: str | None):
        self.model, self.fast = model, None
        with open(model, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            made = lambda p: tiktoken.Encoding("own", pat_str=p, mergeable_ranks=table, special_tokens={})
            # Without runs of white space the look-ahead decides nothing, and splitting is faster without it.
            self.fast, self.plain = made(pattern), made(pattern.replace(LOOK_AHEAD, ""))

    @cached_property
    def full(self):
        """Loaded when a text first needs it, as it takes much memory."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.model)

    def __call__(self, text: str) -> np.ndarray:
        plain = not text.encode().translate(None, _ASCII) if text.isascii() else _PLAIN.fullmatch(text)
        if self.fast and plain and not any(s in text for s in self.special):
            return np.frombuffer(array("I", (self.fast if _SPACES.search(text) else self.plain).encode_ordinary(text)), np.uint32)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(model: str, ranks: str | None, pattern: str | None) -> Encoder:
    return Encoder(model, ranks, pattern)


def small(numbers: np.ndarray) -> bytes:
    """Whole numbers as 16 bits each if they all fit, else 32."""
    return numbers.astype(np.uint16 if not len(numbers) or numbers.max() < 65536 else "<u4").tobytes()


def large(data: bytes, n: int) -> np.ndarray:
    """small()'s n numbers."""
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else "<u4").astype("<u4")


def _buckets(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and frequency of each different term of each text, in order of documents."""
    key, n = np.unique(words.doc.astype(np.uint64) * np.uint64(TERMS) + words.hashes[0] % np.uint64(TERMS), return_counts=True)
    return (key // np.uint64(TERMS)).astype(np.int64), (key % np.uint64(TERMS)).astype(np.int32), n


def _count_documents(acc: np.ndarray, words: Words) -> None:
    """Document frequencies; then the numbers of documents and of words."""
    acc[:TERMS] += np.bincount(_buckets(words)[1], minlength=TERMS).astype(np.uint64)
    acc[TERMS] += np.uint64(len(words.counts))
    acc[TERMS + 1] += np.uint64(words.counts.sum())


def bm25(idf: np.ndarray, tf: np.ndarray, sizes: np.ndarray, mean_size: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes / max(mean_size, 1e-9)))


def sketched(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Unit count sketches of n documents' weights, whose products come near the cosines; 0 for a document without terms."""
    at = mix(term.astype(np.uint64) + np.uint64(1))
    sign = np.where(at >> np.uint64(63), 1.0, -1.0)
    out = np.bincount(doc * SKETCH + (at % np.uint64(SKETCH)).astype(np.int64), sign * weight, n * SKETCH).astype(np.float32).reshape(n, SKETCH)
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-12)[:, None]
    return out


class Order:
    """Documents in order of content. A document's key is its nearest topic (topics themselves in order of their first principal
    component), the second nearest, the signs of PLANES projections of what the topic leaves, and a hash. Alike documents are
    near each other at every size of corpus and topic, and copies, which differ by the hash alone, can be parted anywhere.

    bounds: keys that part the order into ranges of about as many words each, by the sample's words, at the start of a topic
    where one lies between two bounds."""

    def __init__(self, sample: np.ndarray, sizes: np.ndarray, shards: int):
        self.topics = np.zeros((0, SKETCH), np.float32)
        self.planes = np.random.default_rng(5).standard_normal((SKETCH, PLANES)).astype(np.float32)
        self.bounds = np.zeros(0, np.int64)
        if shards == 1 or not len(sample):
            return
        found = fit_centroids(sample, max(1, min(shards, MAX_TOPICS, len(sample) // 8)))
        main = np.linalg.svd(found - found.mean(axis=0), full_matrices=False)[2][0]
        self.topics = found[np.argsort(found @ main, kind="stable")].astype(np.float32)
        keys = self.keys(sample, np.arange(len(sample)))
        order = np.argsort(keys, kind="stable")
        keys, so_far = keys[order], np.cumsum(sizes[order])
        parts = max(1, min(-(-shards // PART_SHARDS), len(sample) // 4))
        last, bounds = -1, []
        for at in np.searchsorted(so_far, so_far[-1] * np.arange(1, parts) / parts):
            key = int(keys[at])
            start = key >> TOPIC_SHIFT << TOPIC_SHIFT
            last = start if start > last else max(key, last)
            bounds.append(last)
        self.bounds = np.unique(np.array(bounds, np.int64))

    def keys(self, x: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """Keys of documents with sketches x; a document without terms comes after all topics."""
        out = mix(hashed.astype(np.uint64)) >> np.uint64(64 - HASH_BITS)
        if not len(self.topics):
            return out.astype(np.int64)
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024].astype(np.float32, copy=False)
            near, row = part @ self.topics.T, np.arange(len(part))
            first = near.argmax(axis=1)
            near[row, first] = -2
            second = near.argmax(axis=1)
            signs = ((part - self.topics[first]) @ self.planes > 0) @ (1 << np.arange(PLANES))
            first[~part.any(axis=1)] = len(self.topics)
            out[lo : lo + 1024] |= ((first << TOPIC_SHIFT) | (second << (PLANES + HASH_BITS)) | (signs << HASH_BITS)).astype(np.uint64)
        return out.astype(np.int64)


def shards_of(rows: Iterator[tuple[int, int, tuple]], words: int) -> Iterator[list[tuple]]:
    """Rows of (topic, size, row), in order, as shards: a new one begins with a topic once half of `words` are reached, and
    anywhere before 1.5 times as many would be passed. One shard is held at a time."""
    some: list[tuple] = []
    held, last = 0, None
    for topic, size, row in rows:
        if some and (held + size > 1.5 * words or (held >= words / 2 and topic != last)):
            yield some
            some, held = [], 0
        some.append(row)
        held, last = held + size, topic
    if some:
        yield some


class Index:
    """Inverted lists of one shard with BM25 weights from the whole corpus's statistics. A document asks by all its terms."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], sizes: np.ndarray, idf: np.ndarray, mean_size: float):
        doc, term, tf = np.repeat(np.arange(len(terms)), [len(t) for t in terms]), np.concatenate(terms), np.concatenate(counts).astype(np.float64)
        weight = bm25(idf[term], tf, sizes[doc], mean_size)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.terms, self.begin = np.unique(term[order], return_index=True)
        self.end = np.append(self.begin[1:], len(order))
        self.n = len(terms)
        self.asks = [np.searchsorted(self.terms, t) for t in terms]
        # Long lists are rows of weights for all documents, which add up faster; they hold at most 1 / COMMON numbers an entry.
        long = np.nonzero(self.end - self.begin > COMMON * self.n)[0]
        self.row = np.full(len(self.terms), -1, np.int64)
        self.row[long] = np.arange(len(long))
        self.block, self.common = -1, np.zeros((0, self.n))
        self.rows = np.zeros((len(long), self.n))
        for k, t in enumerate(long):
            self.rows[k, self.doc[self.begin[t] : self.end[t]]] = self.weight[self.begin[t] : self.end[t]]

    def scores(self, seed: int) -> np.ndarray:
        """Scores of all documents, to 9 decimals, so that copies tie. Common terms are added up for SEEDS seeds at a time."""
        if seed // SEEDS != self.block:
            self.block = seed // SEEDS
            asked = np.zeros((SEEDS, len(self.rows)))
            for k, asks in enumerate(self.asks[self.block * SEEDS : (self.block + 1) * SEEDS]):
                row = self.row[asks]
                asked[k, row[row >= 0]] = 1
            self.common = asked @ self.rows
        asks = self.asks[seed]
        asks = asks[self.row[asks] < 0]
        many = self.end[asks] - self.begin[asks]
        at = np.repeat(self.begin[asks] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.round(self.common[seed % SEEDS] + np.bincount(self.doc[at], self.weight[at], self.n), 9)


def pack(lengths: np.ndarray, scores, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of fragments as (fragment, from, length). Each unused fragment in turn is a seed; its unused neighbours follow
    by score, whole while they fit; then the best one left is cut to fill what remains, its rest a fragment to be used later.
    Without a neighbour, the next fragments in order serve."""
    left, start = lengths.copy(), np.zeros(len(lengths), np.int64)
    for seed in range(len(lengths)):
        while left[seed]:
            taken, room = [(seed, int(start[seed]), int(left[seed]))], window - int(left[seed])
            start[seed], left[seed] = start[seed] + left[seed], 0
            if room:
                near = scores(seed)
                near[left == 0] = -1
                order = np.argsort(-near, kind="stable")
                order = order[near[order] >= 0]
                fits, cut = order[np.cumsum(left[order]) <= room], order
                for f in fits:
                    taken.append((int(f), int(start[f]), int(left[f])))
                    room -= int(left[f])
                    start[f], left[f] = start[f] + left[f], 0
                if room and len(cut) > len(fits):
                    f = cut[len(fits)]
                    taken.append((int(f), int(start[f]), room))
                    start[f], left[f] = start[f] + room, left[f] - room
            yield taken


def retrieval_packing(docs: DataFrame, model: str, window: int = 1024, end_id: int = 0, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids, with end_id after them, are cut into whole windows, which are sequences of their own, and a last
    fragment. Documents are put in order of content (see Order, fitted on a sample), whose ranges are tasks and are read in
    shards of about SHARD_WORDS words, so that neighbours meet; a shard holds an inverted index of its documents, weighted by
    document frequencies and mean length of the whole corpus, and pack() fills windows from it, full up to the last one of a
    shard. A task holds one shard at a time, whatever its range holds. Document frequencies are of hashed terms (a fixed-size
    array, which is what is broadcast). Texts are read twice, for the frequencies and to encode them, and those of the sample
    once more. Only fragments and term counts are shuffled. model (and ranks, pattern: the same vocabulary for tiktoken) must
    name the same files on every executor.

    Null or empty text: end_id alone. Rows that repeat an id are packed each for itself. Null ids pass through. No rows in,
    no rows out. Other columns are not read."""
    spark = ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sums = summed(docs, text, TERMS + PIECES, _count_documents)
    df, n, total = sums[:TERMS].astype(np.float64), int(sums[TERMS]), int(sums[TERMS + 1])
    shards = max(1, -(-total // SHARD_WORDS))
    mean_size = total / max(1, n)
    idf = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32))

    def sketches(words: Words, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        weight = bm25(idf.value[term], tf, words.counts[doc], mean_size)
        for lo in range(0, len(words.counts), 1024):
            hi = min(lo + 1024, len(words.counts))
            a, b = np.searchsorted(doc, [lo, hi])
            yield slice(lo, hi), sketched(doc[a:b] - lo, term[a:b], weight[a:b], hi - lo)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, words in blocks(arrow_rows(batches)):
            for own, x in sketches(words, *_buckets(words)):
                yield pa.RecordBatch.from_pydict({"key": pa.array(key[own], pa.int64()), "x": pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()), "size": pa.array(words.counts[own], pa.int64())})

    fit = (np.zeros((0, SKETCH)), np.zeros(0))
    if shards > 1:
        key = F.xxhash64(F.lit(3), F.col(id_col).cast("string"), text)
        share = int(min(1.0, SAMPLE / n) * (1 << 20)) + 1
        some = docs.select(key.alias("key"), text.cast("binary").alias("text")).filter(F.pmod("key", F.lit(1 << 20)) < share)
        some = some.mapInArrow(sampled, "key long, x binary, size long").orderBy("key").limit(SAMPLE).select("x", "size").toArrow()
        x = np.empty((len(some), SKETCH), np.float32)
        for i, sketch in enumerate(some["x"]):
            x[i] = np.frombuffer(sketch.as_buffer(), np.float32)
        there = x.any(axis=1)
        fit = (x if there.all() else x[there], some["size"].to_numpy().astype(np.float64)[there])
        del some, x, there
    order = Order(*fit, shards)
    del fit
    parts, fitted, shard_words = len(order.bounds) + 1, spark.sparkContext.broadcast(order), SHARD_WORDS
    kind = dict(docs.dtypes)[id_col]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model, ranks, pattern)
        for some, texts, words in blocks(arrow_rows(batches)):
            doc, term, tf = _buckets(words)
            bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
            out: dict[str, list] = {k: [] for k in ("id", "n", "crcs", "rest", "terms", "tf")}
            # Rows of one id and text are told apart by their place, so that copies can be parted too.
            hashed = np.array([zlib.crc32(t if i is None else i.encode()) + k for k, (i, t) in enumerate(zip(some, texts))], np.uint64)
            keys = np.concatenate([fitted.value.keys(x, hashed[own]) for own, x in sketches(words, doc, term, tf)])
            for k, t in enumerate(texts):
                tokens = np.append(encode(t.decode()), np.uint32(end_id)).astype("<u4")
                whole = len(tokens) // window * window
                out["id"].append(some[k])
                out["n"].append(len(tokens))
                out["crcs"].append(np.array([zlib.crc32(tokens[j : j + window].tobytes()) for j in range(0, whole, window)], np.uint32).tobytes())
                rest = tokens[whole:]
                out["rest"].append(small(rest))
                own = slice(bounds[k], bounds[k + 1])
                out["terms"].append(term[own].tobytes())
                out["tf"].append(small(tf[own]))
            kinds = {"id": pa.string(), "n": pa.int64()}
            columns = {k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()}
            part = np.searchsorted(fitted.value.bounds, keys, "right").astype(np.int32)
            yield pa.RecordBatch.from_pydict({**columns, "size": pa.array(words.counts, pa.int64()), "part": pa.array(part), "key": pa.array(keys)})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r[-1] >> TOPIC_SHIFT, r[6], r) for r in arrow_rows(batches))
        for number, some in enumerate(shards_of(rows, shard_words)):
            yield pa.RecordBatch.from_pandas(packed_shard(some, (some[0][-2] << 50) + (number << 32)), schema, preserve_index=False)

    def packed_shard(some: list[tuple], first: int) -> pd.DataFrame:
        some.sort(key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        ids, n, crcs, rest, terms, tf, sizes = list(zip(*some))[:7]
        rows, tokens = [], np.array(n, np.int64)
        fragment = tokens % window
        rest = [large(b, m) for b, m in zip(rest, fragment)]
        for k, own in enumerate(crcs):
            for j, crc in enumerate(np.frombuffer(own, np.uint32)):
                rows.append((k, j * window, window, int(crc), first, 0))
                first += 1
        terms = [np.frombuffer(b, np.int32) for b in terms]
        index = Index(terms, [large(b, len(t)) for b, t in zip(tf, terms)], np.array(sizes, np.int64), idf.value, mean_size)
        for taken in pack(fragment, index.scores, window):
            offset = 0
            for k, start, length in taken:
                rows.append((k, int(tokens[k] - fragment[k]) + start, length, zlib.crc32(rest[k][start : start + length].tobytes()), first, offset))
                offset += length
            first += 1
        out = pd.DataFrame(rows, columns=["k", "start", "length", "ids_crc32", "sequence_id", "offset"])
        out["id"], out["doc_tokens"] = np.array(ids, object)[out["k"]], tokens[out["k"]]
        return out[schema.names]

    schema = pa.schema([("id", pa.string()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text.cast("binary").alias("text"))
    rows = rows.mapInArrow(encoded, "id string, n long, crcs binary, rest binary, terms binary, tf binary, size long, part int, key long")
    # The range is the partition, so a lost task's rows come together again in the same order, and hot topics are many tasks.
    rows = rows.repartitionById(parts, "part").sortWithinPartitions("key", "id", "n", "size")
    out = rows.mapInArrow(packed, "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
