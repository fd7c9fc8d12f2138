"""Clock times as text and as seconds after midnight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def time_to_seconds(c: Column) -> Column:
    """H:MM:SS to seconds; hours may be 24 or more. Null unless there are three whole numbers, the last two below 60."""
    parts = F.split(c, ":")
    h, m, s = (F.get(parts, i).try_cast("int") for i in range(3))
    good = (F.size(parts) == 3) & h.isNotNull() & m.between(0, 59) & s.between(0, 59)
    return F.when(good, h * 3600 + m * 60 + s).cast("int")


def seconds_to_time(c: Column) -> Column:
    """HH:MM:SS, with hours beyond 24 as they are."""
    two = lambda x: F.when(x.between(0, 9), F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.concat_ws(":", two(F.floor(c / 3600)), two(F.floor(F.pmod(c, F.lit(3600)) / 60)), two(F.pmod(c, F.lit(60))))


def first_time(a: Column, b: Column) -> Column:
    """a, or b where a is null or empty."""
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def edge_timing(dep: Column, arr: Column) -> Column:
    """Seconds from dep to arr; null if either is missing or arr is earlier."""
    return F.when(arr >= dep, arr - dep)


def effective_rounds(max_rounds: Column, max_transfers: Column) -> Column:
    """Boardings a search may take: never more than transfers allow, plus the first."""
    return F.least(max_rounds, max_transfers + 1)


def duration_text(seconds: Column) -> Column:
    """'N sec (M.M min)', the tenth of a minute rounded half to even on its exact value."""
    tenths = F.rint(seconds / 6.0)
    return F.concat(seconds.cast("long").cast("string"), F.lit(" sec ("), F.format_string("%.1f", tenths / 10), F.lit(" min)"))
