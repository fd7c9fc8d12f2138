"""Periodic runs, vector codes and exact deduplication against brute force and across batches."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import codes, digests, runs
from tramline.shared import cut, work_folder

from . import brute

SCHEMA = "doc_id long, text string"
CLASH = ("id", "digest", "place", "n", "runs", "collapsed", "n_words", "v", "was", "code", "part", "entry", "error", "batch", "attempt", "keep_id")


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASH})


# --- periodic runs ---


def plain_runs(ws, times=4, least=6):
    """Every stretch that a period q cannot be kept beyond, under its smallest period."""
    found = {}
    for q in range(1, len(ws) // 2 + 1):
        i = 0
        while i < len(ws) - q:
            j = i
            while j < len(ws) - q and ws[j] == ws[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, times * q)), key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    ws = brute.words(text)
    n, h = len(ws), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    rs = plain_runs(ws)
    out = {i for s, size, q in rs for i in range(s + q, s + size)}
    best = max(rs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(rs), *told, brute.sha("".join(f"{s},{size},{q}\n" for s, size, q in rs)), brute.sha(" ".join(w for i, w in enumerate(ws) if i not in out)))


def texts(rng, n):
    out = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "a a " * 6, "x " * 3000, "ab cd " * 700 + "ab", " ".join("abcabcabcabcd"), "B b B b B b B b", "é é é é é é\x0b\x0cé"]
    while len(out) < n:
        ws = []
        while len(ws) < rng.randint(0, 60):
            ws += [rng.choice("abc") for _ in range(rng.randint(1, 4))] * rng.choice([1, 1, 4, 5, 7])
        out.append(rng.choice([" ", "\n", " \t"]).join(ws))
    return out


def test_runs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(runs, "TOGETHER", 1 << 17)
    rows = list(enumerate(texts(random.Random(5), 400)))
    got = runs.digest(runs.word_runs(clashing(spark.createDataFrame(rows, SCHEMA)), arrange=runs.repeating)).collect()
    assert len(got) == len(rows)
    planted = 0
    for r in got:
        assert tuple(r)[1:] == contract(r.doc_id, rows[r.doc_id][1]), r.doc_id
        planted += zlib.crc32(str(r.doc_id).encode()) % 10 == 0
    assert planted > 20 and sum(r.n_runs > 0 for r in got) > 100


@pytest.mark.parametrize("times,least", [(2, 2), (3, 1), (4, 6)])
def test_runs_of_sequences(times, least):
    rng = random.Random(times)
    for _ in range(150):
        some = []
        for _ in range(rng.randint(1, 6)):
            s = []
            while len(s) < rng.randint(0, 50):
                s += [rng.randrange(3) for _ in range(rng.randint(1, 5))] * rng.randint(1, 6)
            some.append(s)
        assert runs.maximal_runs([np.array(s, np.int64) for s in some], times, least) == [plain_runs(s, times, least) for s in some]


def test_long_sequences():
    n = 200_000
    assert runs.maximal_runs([np.zeros(n, np.int64), np.arange(n) % 1009, np.arange(n)]) == [[(0, n, 1)], [(0, n, 1009)], []]


def test_runs_of_repeated_rows_null_ids_and_nothing(spark):
    rows = [(7, "a b a b a b a b"), (7, "a b a b a b a b"), (None, "c c c c c c"), (None, None)]
    got = runs.word_runs(spark.createDataFrame(rows, SCHEMA), arrange=runs.repeating)
    assert sorted(((r.doc_id or -1), [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()) == [(-1, [], ""), (-1, [(0, 6, 1)], "c"), (7, [(0, 8, 2)], "a b"), (7, [(0, 8, 2)], "a b")]
    assert runs.digest(runs.word_runs(spark.createDataFrame([], SCHEMA))).count() == 0
    assert runs.word_runs(spark.createDataFrame([("k1", "d d d d d d")], "doc string, text string").withColumn("doc_id", F.lit(3))).count() == 1
    with pytest.raises(ValueError):
        runs.word_runs(spark.createDataFrame(rows, SCHEMA), times=1)


# --- vector codes ---


def plain_codes(rows, parts=16, size=64, rounds=2):
    """rows(vec_id, vector, label) in whole numbers of Python, all parts assigned anew each round."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:size]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        at = [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
        if n == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at) if a[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    errors = [sum(far(c[p], books[p][a[p]]) for p in range(parts)) for c, a in zip(cut, at)]
    by = {}
    for (_, _, label), e in zip(kept, errors):
        by[label] = by.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{x:02x}" for x in a), min(e, codes.LONG), min(by[label], codes.LONG), sha) for (i, _, label), a, e in zip(kept, at, errors)]


VECTORS = "vec_id long, embedding array<double>, label int"
key = lambda r: (r[0] is None, tuple(map(str, r)))


def same(spark, rows, schema=VECTORS, **options):
    got = codes.coded_vectors(clashing(spark.createDataFrame(rows, schema)).repartition(5), **options)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_codes(rows, **options), key=key)


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 3 % 400, [float(x) for x in rng.normal(size=32)], int(rng.integers(0, 4)) if i % 7 else None) for i in range(300)]
    rows += [(1000 + i, [0.25] * 32, 1) for i in range(120)]  # a third are one vector
    rows += [(500, None, 1), (501, [float("nan")] + [0.0] * 31, 1), (502, [float("inf")] + [0.0] * 31, 1), (503, [None] + [0.0] * 31, 1), (None, [1.0] * 32, None), (504, [0.0] * 32, 9), (505, [-1e-9] * 32, 9)]
    rows += [(506, [1.5] * 30, 2), (507, [], 2)]  # shorter ones are filled up
    same(spark, rows)
    same(spark, rows, parts=4, size=7, rounds=4)


def test_codes_of_few_large_and_no_vectors(spark):
    same(spark, [(3, [1.0] * 16, 1), (3, [1.0] * 16, 1), (1, [2.0] * 16, None)])
    same(spark, [(i, [1e9 * i, -1e18 * (i % 3)] + [float(i)] * 14, i % 2) for i in range(40)], size=8)
    assert codes.coded_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert codes.coded_vectors(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0


def test_rounds_send_only_what_changed(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 16)) * 10
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(size=16) * 0.01], 0) for i in range(200)]
    start = spark.createDataFrame(rows, VECTORS).selectExpr("vec_id", "cast(label as string) label", "embedding v").mapInArrow(codes.whole, codes.STATE)
    books, width = codes.first_books(start, 16, 4)
    once = cut(codes.assigned(start, books, width), "once")
    books = codes.updated(books, codes.moved(once, books.entries.shape))
    assert int(books.counts[0].sum()) == 200
    again = codes.assigned(once, books, width)
    assert codes.moved(again, books.entries.shape).count() == 0


# --- exact deduplication ---


def plain_dedup(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    top = {t: max((x for x in ids if x is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, top[low(t)], len(groups[low(t)]), brute.sha(low(t))) for i, t in rows), key=str)


ROWS = [(5, "Abc"), (9, "aBC"), (1, "abc "), (2, None), (3, ""), (4, "É"), (6, "é"), (7, "İstanbul KELVIN K"), (8, "İstanbul kelvin K"), (10, "x" * 300_000), (11, "X" * 300_000), (12, "ſ"), (13, "S"), (None, "abc"), (None, "lone"), (14, "twice"), (14, "TWICE"), (-7, "minus"), (1 << 60, "Minus")]


def check_dedup(rows, got):
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain_dedup(rows)
    assert all(not r.kept or r.doc_id == r.keep_id for r in got)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_exact_dedup_equals_brute_force(spark):
    got = digests.exact_dedup(clashing(spark.createDataFrame(ROWS, SCHEMA)).drop("n_words")).collect()
    check_dedup(ROWS, got)
    assert digests.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_texts_are_told_by_broadcast_others_by_the_index(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "same" if i % 3 == 0 else f"text {rng.randrange(200)}") for i in range(900)]
    for heavy in (1, 3, 10_000):
        monkeypatch.setattr(digests, "HEAVY", heavy)
        check_dedup(rows, digests.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect())


def test_index_over_batches_sessions_and_failures(spark):
    folder = work_folder(spark, "index")
    rows = lambda *r: spark.createDataFrame([(bytes([d]) * 32, i, p) for d, i, p in r], "digest binary, id long, place long")
    index = digests.DigestIndex(spark, folder, 4)
    first = rows((1, 10, 0), (1, 12, 1), (2, 11, 2))
    assert sorted((r.digest[0], r.id, r.place) for r in index.add(first, "monday").collect()) == [(1, 12, 1), (2, 11, 2)]
    # A text that is there already stays as it was first; a batch that is there already is not added again.
    second = rows((2, 99, 3), (3, 20, 4), (3, 20, 5), (None or 4, None, 6))
    assert sorted((r.digest[0], r.id, r.place) for r in index.add(second, "tuesday").collect()) == [(3, 20, 4), (4, None, 6)]
    assert sorted((r.digest[0], r.id, r.place) for r in index.add(second, "tuesday").collect()) == [(3, 20, 4), (4, None, 6)]
    want = [(1, 12, 1, 2), (2, 11, 2, 2), (3, 20, 4, 2), (4, None, 6, 1)]
    told = lambda x: sorted((r.digest[0], r.keep_id, r.keep_place, r.n) for r in x.texts().collect())
    assert told(index) == want
    assert [(r.rows, r.texts, r.fresh) for r in index.log.orderBy("batch").collect()] == [(3, 2, 2), (4, 3, 2)]
    # What an attempt left that did not come to the log is not read.
    rows((5, 1, 1)).selectExpr("digest", "id", "place", "1L n", "'lost' attempt").write.insertInto(index.name)
    assert told(index) == want
    # Another session, which knows only the folder.
    index.close()
    again = digests.DigestIndex(spark.newSession(), folder, 4)
    assert told(again) == want
    small = again.compacted(work_folder(spark, "index"), 2)
    assert told(small) == want
    assert small.add(rows((5, 7, 9), (1, 70, 10)), "wednesday").count() == 1


def test_joins_with_the_index_do_not_shuffle_it(spark):
    index = digests.DigestIndex(spark, work_folder(spark, "index"), 8)
    rows = spark.range(1000).selectExpr("unhex(sha2(cast(id % 700 as string), 256)) digest", "id", "id place")
    index.add(rows, "a")
    held = index.entries().filter("place is not null").select("digest")
    new = spark.range(50).selectExpr("unhex(sha2(cast(id as string), 256)) digest").repartition(8, "digest").hint("merge")
    plan = new.join(held, "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning" not in index.texts()._jdf.queryExecution().executedPlan().toString()
