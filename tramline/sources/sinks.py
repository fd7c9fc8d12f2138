"""Writers: append, replace, replace one partition, and a catalogue of derived tables by feed and options."""

from __future__ import annotations

import hashlib
import json
import logging
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.times import time_to_seconds

log = logging.getLogger(__name__)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def counted(df: DataFrame, path: str, mode: str = "append") -> int:
    """Writes df and returns how many rows that were, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    return seen.get["n"]


def reloaded_edges(edges: DataFrame) -> DataFrame:
    """Cached edges as a graph takes them: transfers of type 2 and no time are station links, and clock texts are read again where
    the seconds are not there. Walk edges are left out; they are made anew from coordinates and options."""
    kind = F.when((F.col("kind") == "transfer") & (F.col("transfer_type") == 2) & (F.coalesce("weight", F.lit(0)) == 0), "station_link").otherwise(F.col("kind"))
    rows = edges.filter("kind <> 'walk'").withColumn("kind", kind)
    return rows.withColumn("dep", F.coalesce("dep", time_to_seconds(F.col("dep_time")))).withColumn("arr", F.coalesce("arr", time_to_seconds(F.col("arr_time"))))


#: Search methods and what else they are called.
METHODS = {"trip_stop": ("trip_stop", "tripstop", "pattern"), "trip_stop_anytime": ("trip_stop_anytime", "anytime"), "multi_edge": ("multi_edge", "multiedge"), "raptor": ("raptor",)}


def method(name: str | None) -> str:
    """The search method of a name in any case, with blanks or hyphens; trip_stop without one."""
    plain = re.sub(r"[\s-]+", "_", (name or "").strip().lower())
    for known, names in METHODS.items():
        if plain in names:
            return known
    if plain:
        raise ValueError(f"no search method is called {name!r}")
    return "trip_stop"


def text_lines(context: DataFrame, journey: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """context(pos, line) lines that begin with one of prefixes, then journey(pos, line): line, in order of `n`."""
    some = F.lit(False)
    for p in prefixes:
        some = some | F.col("line").startswith(p)
    rows = context.filter(some).select(F.lit(0).alias("part"), "pos", "line").unionByName(journey.select(F.lit(1).alias("part"), "pos", "line"))
    return rows.select(F.struct("part", "pos").alias("n"), "line").orderBy("n")


def feature_collection(df: DataFrame, geometry: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature text a row; geometry is GeoJSON text. A collection is the lines of all rows."""
    head = F.concat(F.lit('{"type":"Feature","geometry":'), F.col(geometry), F.lit(',"properties":'), F.to_json(F.struct(*properties)), F.lit("}"))
    return df.select(head.alias("feature"))


class Catalog:
    """Derived tables kept under root by name, feed and all options, so another option never finds a stale table.

    An entry is a folder of data and a manifest, written last: version, name, feed, options, files with their sizes, rows and columns.
    A table is found only by a manifest that says what is asked for and whose files are there as it says; anything else, a
    damaged file, another version, a write that did not end, is a miss, and the table is built anew beside what is there. A rebuild
    is a new folder and a manifest of the next number, so whoever reads the old table goes on reading it until vacuum()."""

    def __init__(self, spark: SparkSession, root: str, version: str = "1"):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version

    def path(self, name: str, feed: str, options: dict) -> str:
        key = hashlib.sha256(_text(options).encode()).hexdigest()[:16]
        return f"{self.root}/{name}/feed={feed}/options={key}"

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> dict[str, int]:
        """Names and sizes of what is in a folder; none without one."""
        store, p = self._at(path)
        return {x.getPath().getName(): int(x.getLen()) for x in store.listStatus(p)} if store.exists(p) else {}

    def _numbers(self, path: str) -> list[int]:
        """Numbers of an entry's manifests, the latest first."""
        return sorted((int(m[1]) for n in self._names(path) if (m := re.fullmatch(r"manifest-(\d+)\.json", n))), reverse=True)

    def _wrong(self, path: str, number: int, name: str, feed: str, options: dict) -> tuple[str | None, dict]:
        """What is wrong with a manifest or its files, if anything, and the manifest."""
        try:
            said = json.loads(self.spark.read.text(f"{path}/manifest-{number}.json", wholetext=True).first()[0])
            asked = {"version": self.version, "name": name, "feed": feed, "options": json.loads(_text(options))}
            if other := [k for k, v in asked.items() if said[k] != v]:
                return f"another {other[0]}", said
            there = self._names(f"{path}/{said['data']}")
            if other := [n for n, size in said["files"].items() if there.get(n) != size]:
                return f"{other[0]} is not there or not whole", said
        except (ValueError, KeyError, TypeError):
            return "the manifest cannot be read", {}
        return None, said

    def found(self, name: str, feed: str, options: dict) -> DataFrame | None:
        """The table of the latest manifest that holds, if any does."""
        path = self.path(name, feed, options)
        for number in self._numbers(path):
            wrong, said = self._wrong(path, number, name, feed, options)
            if not wrong:
                log.info("%s of %s: read from entry %d, %d rows", name, feed, number, said["rows"])
                return self.spark.read.schema(StructType.fromJson(said["columns"])).parquet(f"{path}/{said['data']}")
            log.warning("%s of %s: entry %d left out: %s", name, feed, number, wrong)
        return None

    def put(self, name: str, feed: str, options: dict, df: DataFrame) -> DataFrame:
        """Writes a table as the entry's next one and returns it as it is read from there."""
        path = self.path(name, feed, options)
        data = f"data-{uuid.uuid4().hex[:12]}"
        rows = counted(df, f"{path}/{data}", "errorifexists")
        files = {n: size for n, size in self._names(f"{path}/{data}").items() if n.endswith(".parquet")}
        said = {"version": self.version, "name": name, "feed": feed, "options": json.loads(_text(options)), "data": data, "files": files, "rows": rows, "columns": df.schema.jsonValue()}
        store, temp = self._at(f"{path}/{data}.json")
        out = store.create(temp)
        out.write(json.dumps(said).encode())
        out.close()
        number = max(self._numbers(path), default=0) + 1
        while not store.rename(temp, self._at(f"{path}/manifest-{number}.json")[1]):  # another writer has that number
            number += 1
        log.info("%s of %s: written as entry %d, %d rows", name, feed, number, rows)
        return self.spark.read.schema(df.schema).parquet(f"{path}/{data}")

    def get_or_build(self, name: str, feed: str, options: dict, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
        have = None if rebuild else self.found(name, feed, options)
        return have if have is not None else self.put(name, feed, options, build())

    def vacuum(self, name: str, feed: str, options: dict) -> int:
        """Deletes all of an entry but its latest whole table; nothing may read the others any more. How many folders went."""
        path = self.path(name, feed, options)
        keep = next((s["data"] for n in self._numbers(path) for w, s in [self._wrong(path, n, name, feed, options)] if not w), None)
        gone = 0
        for number in self._numbers(path):
            said = self._wrong(path, number, name, feed, options)[1]
            if said.get("data") != keep:
                store, p = self._at(f"{path}/manifest-{number}.json")
                store.delete(p, False)
        for folder in self._names(path):
            if folder.startswith("data-") and not folder.startswith(keep or "-"):
                store, p = self._at(f"{path}/{folder}")
                store.delete(p, True)
                gone += not folder.endswith(".json")
        return gone


def _text(options: dict) -> str:
    return json.dumps(options, sort_keys=True, default=str)
