"""The mix's draw and the packer's choice of neighbours against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import packing, source_mix

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# --- mixing ---


def plain_mix(rows, by_size, weights=(5, 2, 1), share=1.5, cap=2.0, seed=7):
    """rows(draw, size, source) -> copies of each: targets by raising a level, expected copies, whole ones first, then Pareto order."""
    size = Counter()
    for _, n, s in rows:
        size[s] += n
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[k % len(weights)]) for k, s in enumerate(sources)}
    full: set = set()
    while True:
        rest = sum(w[s] for s in sources if s not in full)
        level = (share * sum(size.values()) - sum(cap * size[s] for s in full)) / rest if rest else math.inf
        above = {s for s in sources if w[s] * level > cap * size[s]}
        if above <= full:
            break
        full |= above
    target = {s: cap * size[s] if s in full else level * w[s] for s in sources}
    copies = [0] * len(rows)
    for s in sources:
        own = [k for k, r in enumerate(rows) if r[2] == s]
        weight = {k: float(len(f"{rows[k][1]:b}")) if by_size else 1.0 for k in own}
        full = set()
        while True:
            rest = sum(weight[k] * rows[k][1] for k in own if k not in full)
            level = (target[s] - cap * sum(rows[k][1] for k in full)) / rest if rest else math.inf
            above = {k for k in own if weight[k] * level >= cap}
            if above <= full:
                break
            full |= above
        expected = {k: min(cap, level * weight[k]) for k in own}
        left, ranked = target[s], []
        for k in own:
            copies[k] = math.floor(expected[k])
            left -= copies[k] * rows[k][1]
            pi = expected[k] - copies[k]
            if pi > 0 and rows[k][1]:
                u = (int(hashlib.md5(f"{seed}:{rows[k][0]}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                ranked.append((u / (1 - u) * (1 - pi) / pi, k))
        for _, k in sorted(ranked):
            if left <= 0:
                break
            if left >= rows[k][1] or left > rows[k][1] / 2:
                copies[k] += 1
            left -= rows[k][1]
    return copies, [target[r[2]] for r in rows]


@pytest.mark.parametrize("by_size", [True, False])
def test_the_draw_equals_a_plain_one(spark, by_size):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        source = rng.choice(["a", "a", "a", "b", "c", "d", None])
        text = None if i % 41 == 0 else " ".join(rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 40, 300])))
        rows.append((i, text, "en", source, i * 7))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("size", "target", "_id", "_src", "_w", "_u", "copies", "taken", "_draw")})
    for draw_col, draw in ((None, 0), ("n_chars", 4)):
        hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
        want, targets = plain_mix([(f"{r[draw]}:{hashes[r[0]]}", len(brute.words(r[1])), r[3]) for r in rows], by_size)
        got = {r.doc_id: r for r in source_mix.pareto_mix(df, by_size=by_size, draw_col=draw_col).collect()}
        assert [got[i].copies for i in range(500)] == want
        assert np.allclose([got[i].target for i in range(500)], targets)
        assert all(r.taken == r.copies * r.size for r in got.values()) and 0 < sum(c == 1 for c in want) and sum(c == 2 for c in want)


# --- packing ---


def plain_packing(texts, lengths, window):
    """Windows of (document, from, length), documents in order: each seed takes its unused neighbours by BM25 over all documents."""
    words = [brute.words(t) for t in texts]
    n, mean = len(texts), sum(map(len, words)) / len(texts)
    df = Counter(w for ws in words for w in set(ws))
    idf = {w: float(np.float32(math.log1p((n - d + 0.5) / (d + 0.5)))) for w, d in df.items()}
    tf = [Counter(ws) for ws in words]

    def score(seed, doc):
        k = packing.K1 * (1 - packing.B + packing.B * len(words[doc]) / mean)
        return math.fsum(idf[w] * tf[doc][w] * (packing.K1 + 1) / (tf[doc][w] + k) for w in tf[seed] if w in tf[doc])

    left, start, out = [x % window for x in lengths], [x // window * window for x in lengths], []

    def take(d, size):
        out[-1].append((d, start[d], size))
        start[d] += size
        left[d] -= size

    for seed in range(n):
        while left[seed]:
            out.append([])
            room = window - left[seed]
            take(seed, left[seed])
            near = sorted((d for d in range(n) if left[d]), key=lambda d: (-round(score(seed, d), 9), d)) if room else []
            for k, d in enumerate(near):
                if left[d] > room:
                    if room:
                        take(d, room)
                    break
                room -= left[d]
                take(d, left[d])
    return out


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(6)
    topics = [[f"{a}{b}{c}" for b in "aeiou" for c in "rstl"] for a in "bdkm"]
    texts = [" ".join(rng.choice(topics[k % 4] if rng.random() < 0.8 else rng.choice(topics)) for _ in range(rng.randint(1, 60))) for k in range(90)]
    texts[10] = texts[50] = texts[70]
    texts[20], texts[21], texts[22] = "", " ", texts[1] * 9
    rows = [(100 + i, t, "en", "s", 0) for i, t in enumerate(texts)]
    model, ranks = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    encode = packing.encoder(model, ranks, public_tokenizers.PATTERN)
    lengths = [len(encode(t)) + 1 for t in texts]
    for window in (64, 256):
        got: dict[int, list] = {}
        for r in packing.retrieval_packing(spark.createDataFrame(rows, SCHEMA), model, window=window, ranks=ranks, pattern=public_tokenizers.PATTERN).collect():
            got.setdefault(r.sequence_id, []).append((r.offset, r.doc_id - 100, r.start, r.length))
        windows = {tuple(p[1:] for p in sorted(ps)) for ps in got.values()}
        whole = {((d, s, window),) for d, n in enumerate(lengths) for s in range(0, n // window * window, window)}
        assert windows == whole | {tuple(w) for w in plain_packing(texts, lengths, window)}


def test_order_parts_hot_topics_and_copies():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, packing.SKETCH))
    x = centres[rng.integers(0, 12, 6000)] + 0.4 * rng.standard_normal((6000, packing.SKETCH))
    x[:2000] = x[0]  # copies, a third of all rows
    x[2000:2005] = 0
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    order = packing.Order(x[::3][x[::3].any(axis=1)], np.full(2000, 100)[x[::3].any(axis=1)], 60)
    hashed = np.arange(6000, dtype=np.uint64)
    keys = order.keys(x.astype(np.float32), hashed)
    assert (keys == order.keys(x.astype(np.float32), hashed)).all() and (keys >= 0).all()
    assert (keys[2000:2005] >> packing.TOPIC_SHIFT == len(order.topics)).all()
    assert len(np.unique(keys[:2000] >> packing.HASH_BITS)) == 1 and len(np.unique(keys[:2000])) > 1900
    share = np.bincount(np.searchsorted(order.bounds, keys, "right"))
    assert len(share) == len(order.bounds) + 1 > 10 and share.max() < 4 * 6000 / len(share)
    none = packing.Order(np.zeros((0, packing.SKETCH)), np.zeros(0), 60)
    assert len(none.bounds) == 0 and (none.keys(x[:5], hashed[:5]) >> packing.HASH_BITS == 0).all()


def test_shards_end_with_topics_and_stay_small():
    rng = random.Random(8)
    rows = [(t, rng.choice([0, 1, 30, 60]), (t, k)) for t in range(40) for k in range(rng.choice([1, 5, 200]))] + [(40, 5_000, (40, 0))]
    shards = list(packing.shards_of(iter(rows), 1000))
    size = {r[2]: r[1] for r in rows}
    assert [r for s in shards for r in s] == [r[2] for r in rows]
    assert all(sum(size[r] for r in s) <= 1500 or len(s) == 1 for s in shards)
    assert all(sum(size[r] for r in s) >= 500 for s in shards[:-2]) and list(packing.shards_of(iter([]), 1000)) == []


def test_centroids_of_single_precision_are_those_of_double():
    from tramline.llm.vectors import fit_centroids

    x = np.random.default_rng(4).standard_normal((5000, 32)).astype(np.float32)
    assert (fit_centroids(x, 40) == fit_centroids(x.astype(np.float64), 40)).all()


def test_driver_copies_the_sketch_of_counts_in_slices():
    import tracemalloc

    from tramline.llm import jaccard

    seen = (np.arange(1 << 22, dtype=np.uint64) ** 2 % 70_001).astype(np.uint32)
    tracemalloc.start()
    logs = jaccard.log_classes(seen)
    mean = jaccard.rare_length(seen, logs, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * seen.nbytes + len(logs)  # 2^22 words of 8 bytes twice would be four times seen
    whole = seen.astype(np.float32)
    assert (logs == (8 * np.log2(whole + 1)).astype(np.uint8)).all()
    held, cells = np.bincount(logs, whole, 256), np.maximum(1, np.bincount(logs, minlength=256))
    taken = np.clip(0.2 * held.sum() - np.concatenate([[0], np.cumsum(held)[:-1]]), 0, held)
    assert mean == float((taken * held / cells).sum() / max(1.0, taken.sum()))
