"""Deterministic sharded WARC writer and its reader."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterable, Iterator
from functools import reduce
from uuid import uuid4

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import cut, delete, join_counted, passing, ship, work_folder, write

#: Bins that a range of ids is divided into at a time, at most, and tasks that write, at most.
BINS, TASKS = 4096, 10_000
RECORD = "path string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
FILES = "temp string, path string, records long, bytes long, sha256 string"


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _sha1(data: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else int(page_id)}>"


def _line(value: str) -> str:
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def record(page_id, url: str | None, payload: bytes, refers_to, date: str, size: int | None = None, sha1: str | None = None) -> bytes:
    """One WARC/1.1 record as a gzip member of its own. All lengths and digests are taken from the bytes written; a revisit,
    whose payload is not written, is given that payload's size and SHA-1 (hex)."""
    revisit = refers_to is not None
    size, digest = (size, "sha1:" + b32encode(bytes.fromhex(sha1)).decode()) if revisit else (len(payload), _sha1(payload))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def with_revisits(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload (binary), refers_to. Of equal payloads of min_bytes or more, the largest id is the response."""
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    keyed = rows.withColumn("_d", F.concat_ws(".", F.sha1("payload"), F.octet_length("payload")))
    sums = keyed.filter(F.octet_length("payload") >= min_bytes).groupBy("_d").agg(F.max("page_id").alias("_top"), F.count("*").alias("_n"))
    copied = cut(sums.filter("_n > 1").select("_d", "_top"), "warc-copied")
    out = join_counted(keyed, copied, "_d")
    return out.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("_top")), F.col("_top")).alias("refers_to"))


def shard_tree(places: DataFrame, shard_bytes: int) -> tuple[list[DataFrame], DataFrame]:
    """places(page_id, h, n) -> the levels of a tree over the records' order, and its leaves' shards.

    The order is page_id (null first), then h. A node of more than shard_bytes is divided into equal steps between its own least
    and largest id, or hash if it has one id only, so ids that lie far apart, in clusters or all on one value cost a level more
    and not a large task. A level: path, by_id, low, width of the nodes it divides. Leaves: path, first, parts; what is larger
    than a shard there is one row repeated, which `parts` shards share."""
    sums = [F.sum("n").alias("bytes"), F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.count(F.when(F.col("page_id").isNull(), 1)).alias("nulls"), F.min("h").alias("low_h"), F.max("h").alias("high_h")]
    rows, levels, leaves = places.withColumn("path", F.array().cast("array<int>")), [], []
    while True:
        nodes = cut(rows.groupBy("path").agg(*sums), "warc-nodes")
        by_id = (F.col("low") < F.col("high")) | (F.col("low").isNotNull() & (F.col("nulls") > 0))
        divided = (F.col("bytes") > shard_bytes) & (by_id | (F.col("low_h") < F.col("high_h")))
        wide = lambda c: F.col(c).cast("decimal(20,0)")
        low, high = (F.when(by_id, wide(c)).otherwise(wide(f"{c}_h")) for c in ("low", "high"))
        steps = F.least(F.lit(BINS), F.greatest(F.lit(2), F.ceil(8 * F.col("bytes") / shard_bytes)))
        level = cut(nodes.filter(divided).select("path", by_id.alias("by_id"), low.alias("_low"), (F.floor((high - low) / steps) + 1).cast("decimal(20,0)").alias("_width")), "warc-level")
        leaves.append(nodes.filter(~divided).select("path", "bytes"))
        if level.isEmpty():
            break
        levels.append(level)
        rows = descend(rows, level, "inner")
    sized = cut(reduce(DataFrame.unionByName, leaves), "warc-leaves").withColumn("top", F.get("path", F.lit(0)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # The first digit has BINS values at most; the leaves are added up within each.
    tops = cut(sized.groupBy("top").agg(F.sum("bytes").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(before(Window.orderBy("top"))), F.lit(0))), "warc-tops")
    upto = F.coalesce(F.sum("bytes").over(before(Window.partitionBy("top").orderBy("path"))), F.lit(0))
    shards = sized.withColumn("_upto", upto).join(tops, sized["top"].eqNullSafe(tops["top"]))
    first = F.floor((F.col("_before") + F.col("_upto")) / shard_bytes).cast("int")
    return levels, cut(shards.select("path", first.alias("first"), F.greatest(F.lit(1), F.floor(F.col("bytes") / shard_bytes)).cast("int").alias("parts")), "warc-shards")


def descend(rows: DataFrame, level: DataFrame, how: str = "left") -> DataFrame:
    """rows(page_id, h, path, ...) one level further down where the level divides their node."""
    at = F.when(F.col("by_id"), F.col("page_id")).otherwise(F.col("h")).cast("decimal(20,0)")
    step = F.coalesce(F.floor((at - F.col("_low")) / F.col("_width")).cast("int") + 1, F.lit(0))
    path = F.when(F.col("_low").isNotNull(), F.concat("path", F.array(step))).otherwise(F.col("path"))
    return join_counted(rows, level, "path", how).withColumn("path", path).drop("by_id", "_low", "_width")


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = 16 << 20, roll_bytes: int = 8 << 20, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", **columns: str) -> DataFrame:
    """Writes pages as WARC files into folder (a URI all executors reach) and returns the manifest table: path, records,
    bytes (compressed), sha256.

    Shards are ranges of page_id, and within one id of a hash of url and payload, with about shard_bytes of payload each. Their
    bounds come from exact byte sums (see shard_tree()), so the same rows always make the same shards, whatever the input's
    partitions; only a row repeated for more than a shard is dealt to its shards by place. A shard is one task; its records are
    sorted and written one gzip member each; a file is closed once it has roll_bytes of
    compressed data. A task writes under a name of its own attempt and only reports it; the reports of the attempts that
    Spark accepted are the manifest, written by Spark, after which files take their final names. A rename that was cut off
    is finished by its retry, and readers go by the manifest alone, so files of lost attempts are never read; what is left
    under temporary names is deleted in the end.

    Null html: an empty payload. Null url: no target header. Null page_id: first, by the name "null". Rows that repeat a
    page_id with the same payload are all of that record's type. Every record carries `date`. No rows: an empty manifest."""
    with passing(pages.sparkSession):
        return _write_warc(pages, folder, shard_bytes, roll_bytes, min_bytes, date, **columns)


def _write_warc(pages: DataFrame, folder: str, shard_bytes: int, roll_bytes: int, min_bytes: int, date: str, **columns: str) -> DataFrame:
    spark = ship(pages.sparkSession)
    size = F.octet_length("payload").cast("long")
    sent = F.when(F.col("refers_to").isNull(), F.col("payload"))
    rows = with_revisits(pages, min_bytes, **columns).select("page_id", "url", sent.alias("payload"), "refers_to", F.xxhash64("url", "payload").alias("h"), size.alias("size"), F.sha1("payload").alias("sha1"))
    levels, leaves = shard_tree(cut(rows.select("page_id", "h", (F.coalesce(F.octet_length("payload"), F.lit(0)) + 500).cast("long").alias("n")), "warc-places"), shard_bytes)
    placed = reduce(descend, levels, rows.withColumn("path", F.array().cast("array<int>")).withColumn("_at", F.monotonically_increasing_id()))
    placed = join_counted(placed, leaves, "path", "inner")
    shard = F.col("first") + F.pmod(F.xxhash64("_at"), F.col("parts")).cast("int")
    count = (leaves.agg(F.max(F.col("first") + F.col("parts"))).first()[0] or 0) + 1
    placed = placed.select(shard.alias("shard"), "page_id", "url", "payload", "refers_to", "h", "size", "sha1").repartitionById(min(count, TASKS), F.pmod("shard", F.lit(min(count, TASKS))))
    placed = placed.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "h", "url", "payload")

    def written(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        store, base = _filesystem(folder)
        store.create_dir(f"{base}/temp", recursive=True)
        out, shard, seq, n, size, digest, temp = None, -1, 0, 0, 0, None, ""

        def closed() -> pd.DataFrame:
            out.close()
            return pd.DataFrame([(temp, f"shard-{shard:06d}-{seq:05d}.warc.gz", n, size, digest.hexdigest())], columns=["temp", "path", "records", "bytes", "sha256"])

        for b in batches:
            for s, page, url, payload, refers, size_, sha1 in zip(b["shard"], b["page_id"].astype(object), b["url"], b["payload"], b["refers_to"].astype(object), b["size"], b["sha1"]):
                if out is not None and (s != shard or size >= roll_bytes):
                    yield closed()
                    seq, out = seq + 1, None
                if s != shard:
                    shard, seq = s, 0
                if out is None:
                    temp = f"temp/{uuid4().hex}.warc.gz"
                    out, n, size, digest = store.open_output_stream(f"{base}/{temp}"), 0, 0, hashlib.sha256()
                data = record(None if pd.isna(page) else page, url, bytes(payload or b""), None if pd.isna(refers) else refers, date, size_, sha1)
                out.write(data)
                digest.update(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            yield closed()

    def renamed(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        store, base = _filesystem(folder)
        for b in batches:
            for temp, path in zip(b["temp"], b["path"]):
                if store.get_file_info(f"{base}/{temp}").type != fs.FileType.NotFound:
                    store.move(f"{base}/{temp}", f"{base}/{path}")
            yield b

    accepted = write(placed.mapInPandas(written, FILES), f"{folder}/manifest-temp")
    manifest = write(accepted.mapInPandas(renamed, FILES).select("path", "records", "bytes", "sha256"), f"{folder}/manifest")
    for left in ("temp", "manifest-temp"):
        delete(spark, f"{folder}/{left}")
    return manifest


def parsed(stream, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream of gzip members; holds one record at a time."""
    member, held = zlib.decompressobj(31), bytearray()
    while data := stream.read(size):
        while data:
            held += member.decompress(data)
            data = member.unused_data if member.eof else b""
            if member.eof:
                head, _, rest = bytes(held).partition(b"\r\n\r\n")
                headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                yield headers, rest[: int(headers["Content-Length"])]
                member, held = zlib.decompressobj(31), bytearray()
    if held:
        raise ValueError("the archive ends within a record")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the archives in the manifest; block and payload digests are checked on the way."""
    ship(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        store, base = _filesystem(folder)
        number = lambda urn: None if urn is None or urn[10:-1] == "null" else int(urn[10:-1])
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            for path in b["path"]:
                with store.open_input_stream(f"{base}/{path}") as stream:
                    rows = []
                    for h, block in parsed(stream):
                        if _sha1(block) != h["WARC-Block-Digest"]:
                            raise ValueError(f"{path}: {h['WARC-Record-ID']} differs from its digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if h["WARC-Type"] == "response" and _sha1(payload) != h["WARC-Payload-Digest"]:
                            raise ValueError(f"{path}: {h['WARC-Record-ID']}'s payload differs from its digest")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        rows.append((path, number(h["WARC-Record-ID"]), length, b32decode(h["WARC-Payload-Digest"][5:]).hex(), h["WARC-Type"], number(h.get("WARC-Refers-To"))))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows = []
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.schema(FILES).parquet(f"{folder}/manifest").select("path")
    # Files are of like size, so they are dealt out one by one; a task reads one after another.
    return files.repartition(max(1, min(TASKS, files.count()))).mapInPandas(read, RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes pages into a new folder of the shared one and reads them back."""
    folder = work_folder(pages.sparkSession, "warc")
    write_warc(pages, folder, **options)
    return read_warc(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
     w AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM w
"""
