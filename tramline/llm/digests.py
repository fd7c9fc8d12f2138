"""Exact deduplication against a persistent index of digests, bucketed and sorted by digest."""

from __future__ import annotations

import hashlib
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, drop, work_folder, write

#: Rows of a bucket, about, and buckets at least and at most.
BUCKET_ROWS, LEAST, MOST = 4_000_000, 16, 8_192
#: Digests that hold more than one row in this many are joined apart, by a broadcast: there are fewer of them than that.
HEAVY = 10_000
ENTRIES = "digest binary, id bigint, place bigint, n bigint, attempt string"
LOG = "batch string, attempt string, rows bigint, texts bigint, fresh bigint"


def normalised(text: Column) -> Column:
    """text in lower case as far as A-Z go; null is empty. lower() is that where no character is longer than a byte."""
    text = F.coalesce(text, F.lit(""))
    exact = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(exact)


class DigestIndex:
    """Which texts a corpus has: a table bucketed and sorted by digest in `folder`/entries, and a log of its batches.

    add() appends to both. Entries carry the name of the attempt that wrote them, and the log, written last, names the attempts
    that count, so what a failed attempt left is never read, and a batch that is in the log already is not added again. An index
    lives as long as its folder: open it in any session by the same folder and number of buckets. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = LEAST):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.name = f"digests_{hashlib.md5(f'{self.folder} {buckets}'.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({ENTRIES}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.folder}/entries'")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            write(spark.createDataFrame([], LOG), f"{self.folder}/log")

    @property
    def log(self) -> DataFrame:
        """One row for each batch: batch, attempt, rows, texts (different ones in it), fresh (those that were new)."""
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")

    def entries(self) -> DataFrame:
        """digest, id, place, n of the batches in the log. Of a text, the entry with a place is the row that stays, the others
        only count its copies in later batches."""
        done = [r["attempt"] for r in self.log.select("attempt").collect()]  # one a batch, until compacted() joins them
        return self.spark.table(self.name).filter(F.col("attempt").isin(done)).drop("attempt")

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Adds rows(digest, id, place), place a number that tells rows apart, as a batch; returns digest, id, place of the texts
        that were new, one row each: the largest id, then the smallest place.

        Rows are first counted by digest (partly before the shuffle, so copies cost little). The counts are dealt out by the
        index's buckets, and merge with them: an anti-join leaves the new texts, a semi-join the known ones. The index's side
        of either is not shuffled. New texts are appended with the row that stays, known ones with their counts alone."""
        seen = self.log.filter(F.col("batch") == batch).first()
        attempt = seen["attempt"] if seen else uuid.uuid4().hex
        if not seen:
            best = F.max(F.struct("id", (-F.col("place")).alias("place"))).alias("b")
            new = rows.groupBy("digest").agg(best, F.count("*").alias("n")).select("digest", F.col("b.id").alias("id"), (-F.col("b.place")).alias("place"), "n")
            new = cut(new.repartition(self.buckets, "digest"), "digest-batch").hint("merge")
            held = self.entries().filter("place is not null").select("digest")
            fresh = new.join(held, "digest", "left_anti")
            known = new.join(held, "digest", "left_semi").select("digest", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("place"), "n")
            both = fresh.unionByName(known).withColumn("attempt", F.lit(attempt))
            both.repartition(self.buckets, "digest").sortWithinPartitions("digest").select("digest", "id", "place", "n", "attempt").write.insertInto(self.name)
            self.spark.catalog.refreshTable(self.name)
            mine = self.spark.table(self.name).filter(F.col("attempt") == attempt)
            told = mine.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("texts"), F.count("place").alias("fresh"))
            told.select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), "rows", "texts", "fresh").coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        return self.spark.table(self.name).filter((F.col("attempt") == attempt) & F.col("place").isNotNull()).select("digest", "id", "place")

    def texts(self) -> DataFrame:
        """One row for each text: digest, keep_id, keep_place, n (rows in all batches). Entries of a digest share a bucket, so
        nothing is shuffled."""
        one = self.entries().groupBy("digest").agg(F.max("place").alias("keep_place"), F.max("id").alias("keep_id"), F.sum("n").alias("n"))
        return one.select("digest", "keep_id", "keep_place", "n")

    def compacted(self, folder: str, buckets: int | None = None) -> DigestIndex:
        """This index written anew as one batch, one sorted file a bucket; for another number of buckets, too."""
        out = DigestIndex(self.spark, folder, buckets or self.buckets)
        rows = self.texts().select("digest", F.col("keep_id").alias("id"), F.col("keep_place").alias("place"), "n", F.lit("compacted").alias("attempt"))
        rows.repartition(out.buckets, "digest").sortWithinPartitions("digest").write.insertInto(out.name)
        self.spark.catalog.refreshTable(out.name)
        told = self.spark.table(out.name).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("texts"), F.count("place").alias("fresh"))
        told.select(F.lit("compacted").alias("batch"), F.lit("compacted").alias("attempt"), "rows", "texts", "fresh").coalesce(1).write.mode("append").parquet(f"{out.folder}/log")
        return out

    def close(self) -> None:
        """Forgets the table's name; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256. Texts are equal if they are after lower-casing
    A-Z; of equal texts the row with the largest id stays (of rows that share it, the first in the written digests).

    Texts are read once, for their digests, which are written; all else works on digests. The rows go into a new index (or
    `index`, which must be empty) in two batches, the upper half of the ids before the lower one, so what the index has already
    is always the row that stays: the second batch is deduplicated by the anti-join and appended. The index then tells each row its text's group. The few digests that hold more than one row in HEAVY
    are told by a broadcast (there are at most HEAVY of them), all others by a merge join, so no task gets a hot text.

    Null or empty texts are equal to each other. A null id is smaller than all others. Rows that repeat id and text are copies
    like others, of which one stays. No rows in, no rows out. Other columns are not read."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))
    rows = cut(rows.withColumn("place", F.monotonically_increasing_id()), "digests")
    low, high, total = rows.agg(F.min("id"), F.max("id"), F.count("*")).first()
    middle = 0 if low is None else (low + high) // 2
    index = index or DigestIndex(spark, work_folder(spark, "digest-index"), max(LEAST, min(MOST, total // BUCKET_ROWS)))
    upper = F.coalesce(F.col("id") > middle, F.lit(False))
    index.add(rows.filter(upper), "upper")
    index.add(rows.filter(~upper), "lower")
    heavy = cut(index.texts().filter(F.col("n") > max(1, total // HEAVY)), "digests-heavy")
    told = rows.join(F.broadcast(heavy), "digest", "left")
    rest = told.filter("n is null").select("digest", "id", "place").hint("merge").join(index.texts(), "digest")
    out = told.filter("n is not null").unionByName(rest)
    kept = F.col("place") == F.col("keep_place")
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("keep_id").cast(kind).alias("keep_id"), F.col("n").cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


_TEXT = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ORACLE = f"""
WITH d AS (SELECT doc_id, sha256({_TEXT}) AS text_sha256 FROM documents),
     g AS (SELECT *, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM d WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
