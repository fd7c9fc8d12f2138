"""Timetable, census and building tables as fixed projections of the star-schema test tables.

The SQL is written once; DIV is the only thing that the two engines spell differently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "stops": """
        SELECT 'S' || s_suppkey AS stop_id, CASE WHEN s_suppkey % 4 <> 0 THEN 'S' || (s_suppkey - s_suppkey % 4) WHEN s_suppkey % 8 = 0 THEN '' END AS parent_station,
               'Stop ' || s_suppkey AS stop_name, CASE WHEN s_suppkey % 97 <> 96 THEN 53.4E0 + ((s_suppkey * 7919) % 1000) * 3E-5 END AS stop_lat,
               CASE WHEN s_suppkey % 97 <> 96 THEN 9.8E0 + ((s_suppkey * 104729) % 1000) * 5E-5 END AS stop_lon, s_suppkey AS k
        FROM {supplier}""",
    "routes": """
        SELECT 'R' || n_nationkey AS route_id,
               CASE n_nationkey % 8 WHEN 0 THEN 'U' || (n_nationkey % 5 + 1) WHEN 1 THEN ' s' || (n_nationkey % 4 + 1) WHEN 2 THEN 'RE' || n_nationkey WHEN 3 THEN 'rb' || n_nationkey
                    WHEN 4 THEN 'A' || (n_nationkey % 3 + 1) WHEN 5 THEN 'SEV U1' WHEN 6 THEN 'Bus ' || n_nationkey ELSE 'S' || n_nationkey END AS route_short_name,
               CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 5 = 1 THEN '##' || substr(md5(n_name), 1, 6) WHEN n_nationkey % 5 = 2 THEN 'zz' || n_nationkey ELSE substr(md5(n_name), 1, 6) END AS route_color,
               n_nationkey AS k
        FROM {nation}""",
    "trips": """
        SELECT 'T' || o_orderkey AS trip_id, 'R' || (o_orderkey % 25) AS route_id, 'V' || (o_orderkey % 7) AS service_id, DIV(o_orderkey, 25) % 2 AS direction_id,
               CASE WHEN o_orderkey % 53 <> 0 THEN 'H' || (o_orderkey % 25) || '_' || (DIV(o_orderkey, 25) % 2) END AS shape_id, o_orderkey AS k
        FROM {orders}""",
    "stop_times": """
        SELECT 'T' || o AS trip_id, 'S' || (((o % 25) * 11 + (DIV(o, 25) % 2) * 3 + seq * 5) % n) AS stop_id, seq AS stop_sequence,
               CASE WHEN (o * 7 + seq) % 211 = 0 THEN '' ELSE CLOCK(a) END AS arrival_time, CASE WHEN (o * 7 + seq) % 223 = 0 THEN NULL ELSE CLOCK((a + 20)) END AS departure_time
        FROM (SELECT o, seq, 14400 + (o * 97) % 72000 + seq * 180 + (o % 5) * 10 AS a, n
              FROM (SELECT o, ln, CAST(row_number() OVER (PARTITION BY o ORDER BY ln) AS INT) AS seq FROM (SELECT DISTINCT l_orderkey AS o, l_linenumber AS ln FROM {lineitem}) d) r
              CROSS JOIN (SELECT count(*) AS n FROM {supplier}) c) t""",
    "transfers": """
        SELECT 'S' || s_suppkey AS from_stop_id, 'S' || ((s_suppkey + 4) % n) AS to_stop_id, CASE WHEN s_suppkey % 3 <> 0 THEN 60 + (s_suppkey % 5) * 30 END AS min_transfer_time, (s_suppkey % 2) * 2 AS transfer_type
        FROM {supplier} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) c""",
    "shapes": """
        SELECT 'H' || r || '_' || d AS shape_id, q AS shape_pt_sequence, 53.4E0 + ((x * 7919) % 1000) * 3E-5 + CASE WHEN r % 8 = 1 AND q >= 5 THEN 2E-2 ELSE 0E0 END AS lat, 9.8E0 + ((x * 104729) % 1000) * 5E-5 AS lon
        FROM (SELECT n_nationkey AS r, d, q, ((n_nationkey * 11 + d * 3 + q * 5) % n) AS x
              FROM {nation} CROSS JOIN (SELECT DISTINCT s_suppkey % 2 AS d FROM {supplier}) dd CROSS JOIN (SELECT DISTINCT l_linenumber AS q FROM {lineitem}) qq CROSS JOIN (SELECT count(*) AS n FROM {supplier}) c) t""",
    "cells": """
        SELECT 'CRS3035RES1000mN' || ((3350 + c_custkey % 60) * 1000) || 'E' || ((4300 + DIV(c_custkey, 60) % 60) * 1000) AS grid_id, 2020 + c_custkey % 3 AS dataset_year, ' ' || c_name || ' ' AS municipality,
               CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '[0-3]' WHEN c_custkey % 13 = 0 THEN '' ELSE '' || (c_custkey % 900) END AS population_raw
        FROM {customer}""",
    "buildings": """
        SELECT 'B' || p_partkey AS building_id, 'LoD1-DE_HH_2023-04-01' AS release, 550000E0 + (p_partkey * 37) % 4000 AS x, 5930000E0 + (p_partkey * 53) % 4000 AS y, 4 + p_size AS w, 6 + p_size % 9 AS d,
               CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey % 6 - 1 END AS storeys, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey % 40) * 8E-1 END AS height
        FROM {part}""",
    "requests": """
        SELECT event_id AS query_id, 'S' || (user_id % n) AS origin, 'S' || ((user_id * 7 + 3) % n) AS destination, 21600 + (event_id * 61) % 50000 AS depart
        FROM {events} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) c WHERE event_type = 'purchase'""",
}
#: Rows of a trip's table that a task gets at most, about: what it sorts then does not grow with the input.
TASK_ROWS = 100_000
SOURCES = ("supplier", "nation", "orders", "lineitem", "customer", "part", "events")


def _spelled(sql: str, spark: bool) -> str:
    """Fills in DIV(a, b) and CLOCK(x)."""
    div = (lambda a, b: f"(({a}) div ({b}))") if spark else (lambda a, b: f"(({a}) // ({b}))")
    clock = lambda x: f"lpad('' || {div(x, '3600')}, 2, '0') || ':' || lpad('' || ({div(x, '60')} % 60), 2, '0') || ':' || lpad('' || ({x} % 60), 2, '0')"
    for word, make in (("CLOCK(", lambda inner: clock(inner)), ("DIV(", lambda inner: div(*[p.strip() for p in inner.split(",", 1)]))):
        while (at := sql.find(word)) >= 0:
            depth, end = 1, at + len(word)
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            sql = sql[:at] + make(sql[at + len(word) : end - 1]) + sql[end:]
    return sql


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Number of tasks that stop times are dealt to by trip, from the rows that the file's footers count."""
    return 1 + spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // TASK_ROWS


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables; only what they need is read."""
    out = []
    for name in names:
        sql = _spelled(TABLES[name], True)
        used = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in SOURCES if f"{{{s}}}" in sql}
        if name == "stop_times":
            used["lineitem"] = used["lineitem"].repartition(tasks(spark, sf_dir), "l_orderkey")
        out.append(spark.sql(sql, **used))
    return out


def ctes(*names: str) -> str:
    """The same tables as a WITH list for the oracle."""
    return ",\n".join(f"{n} AS ({_spelled(TABLES[n], False).format(**{s: s for s in SOURCES})})" for n in names)
