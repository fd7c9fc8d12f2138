"""The corpus operators as queries over whole tables: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, digests, jaccard, packing, personal, quality, runs, secrets, source_mix, substrings, token_counts, vectors, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame) -> DataFrame:
    """Packing with the byte-level vocabulary of 50k."""
    import public_tokenizers

    return packing.retrieval_packing(docs, _tokenizer("byte_bpe_50k.json"), ranks=_tokenizer("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(_docs(spark, sf_dir)))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(personal.personal_spans(_docs(spark, sf_dir)))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.pareto_mix(_docs(spark, sf_dir), by_size=True)


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(_docs(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_docs(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.word_runs(_docs(spark, sf_dir), arrange=runs.repeating))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.coded_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.exact_dedup(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scan, op2_personal_data, op3_warc, op4_token_counts, op5_substring_dedup, op6_retrieval_packing, op7_source_mix, op8_nearest_vectors, op9_jaccard_groups, op10_quality_rules, op11_periodic_runs, op12_vector_codes, op13_exact_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.ORACLE, "op5_substring_dedup": substrings.ORACLE, "op9_jaccard_groups": jaccard.ORACLE, "op12_vector_codes": codes.ORACLE, "op13_exact_dedup": digests.ORACLE}
