"""GTFS folders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

# The files that a feed must and may have, and the columns that are not text.
REQUIRED = ("agency", "calendar", "calendar_dates", "routes", "stop_times", "stops", "trips")
OPTIONAL = ("feed_info", "frequencies", "shapes", "transfers")
INTEGERS = ("location_type", "route_type", "direction_id", "stop_sequence", "pickup_type", "drop_off_type", "shape_pt_sequence", "transfer_type", "min_transfer_time", "exception_type", "headway_secs", "exact_times", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
DOUBLES = ("stop_lat", "stop_lon", "shape_pt_lat", "shape_pt_lon", "shape_dist_traveled")
DATES = ("start_date", "end_date", "date", "feed_start_date", "feed_end_date")


def listed(spark: SparkSession, folder: str) -> list[tuple[str, str, bool]]:
    """Name, path and whether it is a file, of what a folder holds, by name; any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((x.getPath().getName(), x.getPath().toString(), x.isFile()) for x in found)


def files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table name -> path of the folder's .txt files, or folders of part files; other subfolders are not looked into."""
    return {n[:-4]: p for n, p, _ in listed(spark, folder) if n.endswith(".txt")}


def missing(spark: SparkSession, folder: str) -> list[str]:
    """Required tables that the folder lacks."""
    return sorted(set(REQUIRED) - set(files(spark, folder)))


def typed(df: DataFrame) -> DataFrame:
    """Text columns to their types; what cannot be read becomes null. Unknown columns stay text."""
    kinds = {**dict.fromkeys(INTEGERS, "int"), **dict.fromkeys(DOUBLES, "double")}
    cast = lambda c: F.try_to_timestamp(F.trim(c), F.lit("yyyyMMdd")).cast("date") if c in DATES else F.trim(c).try_cast(kinds[c]) if c in kinds else F.col(c)
    return df.select(*[cast(c).alias(c) for c in df.columns])


def read_table(spark: SparkSession, path: str, feed_id: str) -> DataFrame:
    """One file as text with the header's columns, then typed, with feed_id."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    names = [re.sub("^﻿", "", c).strip() for c in rows.columns]
    return typed(rows.toDF(*names)).withColumn("feed_id", F.lit(feed_id))


def read_feed(spark: SparkSession, folder: str, feed_id: str | None = None, skip: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Tables of a feed by name; feed_id is the folder's name unless given. Raises if required files are missing."""
    if lacks := missing(spark, folder):
        raise ValueError(f"missing files: {', '.join(lacks)}")
    feed_id = feed_id or folder.rstrip("/").rpartition("/")[2]
    known = set(REQUIRED) | set(OPTIONAL)
    return {n: read_table(spark, p, feed_id) for n, p in files(spark, folder).items() if n in known and n not in skip}


def read_feeds(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of all feeds in root's subfolders, by name; columns that only some feeds have are null in the others."""
    out: dict[str, DataFrame] = {}
    for folder in [p for _, p, is_file in listed(spark, root) if not is_file]:
        for name, df in read_feed(spark, folder).items():
            out[name] = out[name].unionByName(df, allowMissingColumns=True) if name in out else df
    return out


def the_feed(stops: DataFrame, feed_id: str | None = None) -> str:
    """feed_id, or the only feed of the stops; an error that names them if there are several or none."""
    if feed_id:
        return feed_id
    ids = sorted(r[0] for r in stops.select("feed_id").filter("feed_id <> ''").distinct().limit(20).collect())
    if len(ids) != 1:
        raise ValueError(f"choose a feed: {', '.join(ids) or 'there is none'}")
    return ids[0]


def find_stop(stops: DataFrame, name: str) -> str:
    """Id of the only stop of that name, else of the only one whose name holds it; an error with examples otherwise."""
    for test in (F.lower("stop_name") == name.strip().lower(), F.lower("stop_name").like(f"%{name.strip().lower()}%")):
        got = [r[0] for r in stops.filter(test).select("stop_id").orderBy("stop_id").limit(11).collect()]
        if len(got) == 1:
            return got[0]
        if got:
            raise ValueError(f"{name!r} is ambiguous: {', '.join(got[:10])}")
    raise ValueError(f"no stop is named {name!r}")


def of_feed(df: DataFrame, feed_id: str) -> DataFrame:
    """One feed's rows, without the column that says so."""
    return df.filter(F.col("feed_id") == feed_id).drop("feed_id")


def ingest(spark: SparkSession, folder: str, into: str, feed_id: str | None = None, skip: tuple[str, ...] = (), drop_existing: bool = False, dry_run: bool = False) -> dict[str, int]:
    """Appends a feed's tables to those below `into`, or replaces them with drop_existing, and returns the rows of each. A dry run
    reads and counts only."""
    counts = {}
    for name, df in read_feed(spark, folder, feed_id, skip).items():
        if dry_run:
            counts[name] = df.count()
        else:
            counts[name] = sinks.counted(df, f"{into.rstrip('/')}/{name}", "overwrite" if drop_existing else "append")
    return counts
