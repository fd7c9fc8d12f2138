"""A training corpus in stages: each takes (spark, docs, sf_dir) and returns what the next one gets as docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.jaccard import similar_groups
from tramline.llm.quality import quality_rules
from tramline.llm.queries import pack
from tramline.llm.secrets import redacted, secret_spans
from tramline.llm.source_mix import pareto_mix
from tramline.shared import cut, drop, join_counted, kept, passing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: shingles of five words, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def _keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs and a column that tells its rows apart: doc_id, or, where ids repeat or are null, a number in a written copy."""
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        return docs, "doc_id"
    return cut(docs.withColumn("_row", F.monotonically_increasing_id()), name), "_row"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text has no words, so it goes; null language or source is a group
    of its own; rows that repeat an id are each judged."""
    judged = quality_rules(docs, keep=("text", "lang", "source", "n_chars"))
    return judged.filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar shingle sets reach: the one with the least id, or the first written of
    rows whose ids repeat or are null. A null or empty text or one without words is linked with nothing and stays."""
    rows, key = _keyed(docs, "near-rows")
    groups = similar_groups(rows, WORDS, PERCENT, id_col=key)
    first = cut(groups.filter(F.col(key) == F.col("component_id")).select(key), "near-kept")
    return join_counted(rows, first, key, "inner").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret's span replaced by a mark, and n_chars to match. Null and empty texts, and null ids,
    pass as they are."""
    found = secret_spans(docs, keep=("text", "lang", "source", "n_chars"))
    text = redacted(F.col("text"), F.col("spans"))
    size = F.when(F.size("spans") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 2 times at most. A null or empty text has no words and is not taken; null is
    a source of its own."""
    rows, key = _keyed(docs, "mix-rows")
    taken = pareto_mix(rows, id_col=key, draw_col="doc_id").filter("copies > 0").select(key, "copies")
    taken = cut(taken, "mix-taken")
    return join_counted(rows, taken, key, "inner").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; a null or empty text is its end id alone."""
    return pack(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secrets", secrets), ("source mix", mix), ("packing", packed)]
#: The stages draw, fit and pack; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on the written result of the one before. A stage's working tables are deleted when
    its result is written, and its input when the next one's is, so runs beside each other do not meet; what the last result
    is read from stays in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, work in STAGES[:-1]:
        with passing(spark) as made:
            docs = kept(cut(work(spark, docs, sf_dir), name.replace(" ", "-")), made)
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
