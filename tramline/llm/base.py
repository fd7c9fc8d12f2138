"""What the corpus operators share: word pattern, lambda-bound expressions, shared work folder."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, delete, drop, join_counted, kept, passing, work_folder, write  # noqa: F401

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"
_ROOT = str(Path(__file__).resolve().parents[2])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: Catalyst would otherwise copy it to each place of use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of a text; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words, without building an array of them; 0 for null."""
    marks = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), SEPARATORS, "")
    return F.octet_length(marks).cast("long")


#: Makes Python workers give freed memory back, but for 32 MB, where they would keep it for themselves beside the JVM.
MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": str(32 << 20), "MALLOC_MMAP_THRESHOLD_": str(4 << 20)}


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this library from where the driver has it, and keeps them small."""
    for key, value in MEMORY.items():
        spark.sparkContext.environment.setdefault(key, value)
    env, held = spark.sparkContext.environment, "PYTHONPATH"
    if _ROOT not in env.get(held, "").split(os.pathsep):
        env[held] = os.pathsep.join(filter(None, [_ROOT, env.get(held, "")]))
    return spark
