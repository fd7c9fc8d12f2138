"""Written tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LISTS: list[list[str]] = []
#: Rows up to which a side that has been counted may be broadcast.
BROADCAST_ROWS = 500_000
#: Spark's setting that deletes a query's shuffle files as soon as the query is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this library from where the driver has it."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the cluster's shared spark.checkpoint.dir; in a local folder only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tramline-')}"
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read from there. What it was shuffled through is deleted once it is written."""
    spark = df.sparkSession
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: lineage ends there, and lost executors cost a reread."""
    path = work_folder(df.sparkSession, name)
    for made in _LISTS:
        made.append(path)
    out = write(df, path)
    out._written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote; nothing that is still to run may read them."""
    for t in tables:
        delete(t.sparkSession, t._written_to)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def join_counted(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """left join right. right, a written table whose rows its footers count, is broadcast only up to BROADCAST_ROWS; beyond,
    Spark shuffles both sides and AQE splits skewed keys."""
    return left.join(few(right, right), on, how)


def rows_of(table: DataFrame) -> int:
    """The rows of a written table, counted once."""
    rows = table.__dict__.setdefault("_rows", None)
    if rows is None:
        rows = table._rows = table.count()
    return rows


def few(df: DataFrame, counted: DataFrame) -> DataFrame:
    """df, broadcast if `counted`, a written table that df is made of, has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if rows_of(counted) <= BROADCAST_ROWS else df


def written(spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
    """The rows of tables of one form that cut() wrote, as one."""
    return spark.read.schema(tables[0].schema).parquet(*[t._written_to for t in tables])


@contextmanager
def listing() -> Iterator[list[str]]:
    """The folders that cut() writes meanwhile."""
    made: list[str] = []
    _LISTS.append(made)
    try:
        yield made
    finally:
        _LISTS[:] = [x for x in _LISTS if x is not made]


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes in the end what cut() writes meanwhile, but for what is taken out of the list: for work whose results are
    written by then."""
    with listing() as made:
        yield made
    for path in made:
        delete(spark, path)


def kept(df: DataFrame, made: list[str]) -> DataFrame:
    """df, a written table, taken out of passing()'s list."""
    if df._written_to in made:
        made.remove(df._written_to)
    return df
