"""Stages on a small corpus, against brute force."""

import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from tramline.llm.quality import quality_rules  # noqa: E402
from tramline.shared import cut  # noqa: E402

from . import brute  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, extra=()):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() for _ in range(rng.randint(12, 90))) for _ in range(70)]
    for i in range(0, 20, 2):
        ws = texts[i].split()
        ws[rng.randrange(len(ws))] = word()
        texts.append(" ".join(ws))
    texts += [texts[3], texts[3], "short", "", None, "token=0123456789abcdef " + texts[5]]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)] + list(extra)
    return cut(spark.createDataFrame(rows, SCHEMA), "corpus")


def test_stages_follow_one_another(spark):
    docs = corpus(spark)
    first = {r.doc_id for r in pipeline.quality(spark, docs, "").collect()}
    assert first == {r.doc_id for r in quality_rules(docs).filter("kept").collect()}
    assert all(brute.statistics(r.text)[5] is False for r in docs.collect() if r.doc_id in first)
    kept = cut(pipeline.quality(spark, docs, ""), "kept")

    unique = cut(pipeline.near_duplicates(spark, kept, ""), "unique")
    groups = brute.groups([(r.doc_id, r.text) for r in kept.collect()], pipeline.WORDS, pipeline.PERCENT)
    assert Counter(groups[r.doc_id][1] for r in unique.collect()) == Counter({c for _, c in groups.values()})

    clean = cut(pipeline.secrets(spark, unique, ""), "clean")
    before = {r.doc_id: r.text for r in unique.collect()}
    for r in clean.collect():
        assert not brute.spans(r.text, brute.SECRETS)
        assert r.text == before[r.doc_id] or ("[SECRET]" in r.text and r.n_chars == len(r.text))
    assert clean.count() == len(before)

    mixed = cut(pipeline.mix(spark, clean, ""), "mixed")
    assert mixed.columns == clean.columns == pipeline.COLUMNS
    total = sum(len(r.text.split()) for r in clean.collect())
    assert abs(sum(len(r.text.split()) for r in mixed.collect()) - 1.5 * total) <= 4 * 90
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2

    pieces = pipeline.packed(spark, mixed, "").toPandas()
    assert Counter(pieces.drop_duplicates(["doc_id", "start", "sequence_id", "offset"]).groupby("doc_id").length.sum().index) == Counter({r.doc_id: 1 for r in mixed.collect()})
    whole = sum(n * t for n, t in ((c, pieces[pieces.doc_id == d].doc_tokens.iloc[0]) for d, c in Counter(r.doc_id for r in mixed.collect()).items()))
    assert pieces.length.sum() == whole


def test_null_and_repeated_ids(spark):
    long = " ".join(f"word{i}" for i in range(40))
    extra = [(None, long, "en", None, None), (None, long, None, "x", None), (5, long + " end", "en", "x", 1), (None, None, None, None, None), (5, "another text " + " ".join(f"v{i}" for i in range(30)), "en", "x", 1)]
    docs = corpus(spark, extra)
    out = pipeline.near_duplicates(spark, docs, "").filter(F.col("text").startswith("word0") | F.col("text").startswith("another"))
    assert sorted(r.text[:7] for r in out.collect()) == ["another", "word0 w"]
    assert pipeline.mix(spark, docs, "").filter("doc_id is null").count() <= 6
    assert pipeline.secrets(spark, docs, "").count() == docs.count()


def test_empty_corpus(spark):
    docs = cut(spark.createDataFrame([], SCHEMA), "empty")
    for _, stage in pipeline.STAGES:
        docs = cut(stage(spark, docs, ""), "empty")
    assert docs.count() == 0


def test_runs_beside_each_other(spark, tmp_path):
    path = str(tmp_path)
    corpus(spark).limit(40).write.parquet(f"{path}/documents.parquet")
    first = pipeline.run(spark, path)
    second = pipeline.run(spark, path)
    shown = lambda df: sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32) for r in df.select("doc_id", "start", "length", "ids_crc32").collect())
    assert len(shown(first)) == len(shown(second)) > 0
