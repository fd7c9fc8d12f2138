"""Regular-expression spans with code-point places, in DataFrame functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let


class Kind(NamedTuple):
    """pattern: Java regular expression. group: the one that holds the value.
    fits: function of match and value, or None. maybe: cheap test that a text may hold the kind at all."""

    name: str
    pattern: str
    group: int = 0
    fits: object = None
    maybe: str | None = None


def running(lengths: Column) -> Column:
    """Exclusive running sums of an array of ints, in blocks of its size's square root so that long arrays stay cheap."""

    def over(n: Column) -> Column:
        block = F.ceil(F.sqrt(n)).cast("int")
        ids = F.sequence(F.lit(0), F.ceil((n - 1) / block).cast("int"))
        total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        part = lambda b: F.slice(lengths, b * block + 1, block)
        sums = F.transform(ids, lambda b: total(part(b)))
        before = lambda s: F.transform(s, lambda _, b: total(F.slice(s, 1, b)))
        inside = lambda p: F.transform(p, lambda _, i: total(F.slice(p, 1, i)))
        return let(let(sums, before), lambda done: F.flatten(F.transform(ids, lambda b: let(part(b), lambda p: F.transform(inside(p), lambda x: x + F.get(done, b))))))

    return F.when(F.size(lengths) > 0, let(F.size(lengths), over)).otherwise(F.array().cast("array<int>"))


def kind_spans(text: Column, kind: Kind, rank: int) -> Column:
    """array<struct<start, rank, kind, end, match, value>> of a kind's matches that fit. What split() leaves between the
    matches and the matches themselves give the places."""
    pattern = F.lit(kind.pattern)
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,match:string,value:string>>")

    def found(all_: Column) -> Column:
        return let(F.transform(F.split(text, kind.pattern, -1), lambda x: F.char_length(x)), lambda gaps: placed(all_, gaps))

    def placed(all_: Column, gaps: Column) -> Column:
        values = F.regexp_extract_all(text, pattern, F.lit(kind.group)) if kind.group else all_
        steps = F.transform(all_, lambda m, i: F.get(gaps, i) + F.char_length(m))

        def rows(at: Column) -> Column:
            return let(values, lambda vs: F.transform(all_, lambda m, i: F.struct((F.get(at, i) + F.get(gaps, i)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (F.get(at, i) + F.get(gaps, i) + F.char_length(m)).alias("end"), m.alias("match"), F.get(vs, i).alias("value"))))

        return let(let(steps, running), rows)

    hits = let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda a: F.when(F.size(a) > 0, found(a)).otherwise(none))
    if kind.fits:
        hits = F.filter(hits, lambda s: kind.fits(s["match"], s["value"]))
    return F.when(text.rlike(kind.maybe), hits).otherwise(none) if kind.maybe else hits


def all_spans(text: Column, kinds: list[Kind]) -> Column:
    """Spans of all kinds, by start, then kind as listed."""
    return F.array_sort(F.concat(*[kind_spans(text, k, i) for i, k in enumerate(kinds)]))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
