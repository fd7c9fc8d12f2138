"""Personal data: fixed patterns, and bootstrapped contextual extraction of identifiers that no pattern knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, join_counted, kept, let, passing
from .spans import Kind, all_spans, counted, joined, kind_spans


def _luhn(m: Column) -> Column:
    digits = lambda d: F.reverse(F.split(d, ""))
    worth = lambda x, i: let(x.cast("int") * (1 + i % 2), lambda y: F.when(y > 9, y - 9).otherwise(y))
    sums = let(F.regexp_replace(m, "[^0-9]", ""), lambda d: F.when(F.char_length(d).between(12, 19), F.aggregate(F.transform(digits(d), worth), F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False))
    return sums


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_LOCAL = "[A-Za-z0-9._%+-]"
#: A match may begin inside a run only where the last one ended: elsewhere it would fail as the run's beginning has failed.
BASE = [
    Kind("email", f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", maybe="@"),
    Kind("ip", "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", 0, lambda m, v: m.rlike(f"^{_PART}\\.{_PART}\\.{_PART}\\.{_PART}$"), "[0-9]\\.[0-9]"),
    Kind("card", "[0-9](?:[\\x20-]?[0-9])++", 0, lambda m, v: _luhn(m), "[0-9]"),
    Kind("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", 0, lambda m, v: F.char_length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15), "\\+[0-9]"),
]
_RUN = "[A-Za-z0-9@_#./+-]"
#: What may be an identifier: a run of five characters or more with three digits or more, without the marks at its end.
_TOKEN = Kind("found", f"(?<!{_RUN})(?=[A-Za-z@_#./+-]*+[0-9][A-Za-z@_#./+-]*+[0-9][A-Za-z@_#./+-]*+[0-9])[A-Za-z0-9@_#+]{_RUN}{{4,}}(?<=[A-Za-z0-9])(?![A-Za-z0-9@_#])", maybe="(?s)[0-9].*[0-9].*[0-9]")


#: Pattern words end at white space, and after quotes, brackets and labels, which may be attached to what follows.
_MARKS = "\\x22':=,;|(){}<>\\[\\]"
_SPACE = "\\x20\\x09-\\x0D"
_PIECE = f"[^{_SPACE}{_MARKS}]*+[{_MARKS}]++|[^{_SPACE}{_MARKS}]++"
#: The white space after a place, marks before it aside, and the pattern word that follows.
_NEXT = f"^[{_MARKS}]*+[{_SPACE}]++({_PIECE})"
#: Code points around a place that are cut up first; where a word is longer, all of the text is.
REACH = 160


def _norm(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[0-9]", "9")


def _none() -> Column:
    return F.array().cast("array<string>")


def contexts(text: Column, start: Column, end: Column) -> Column:
    """Lexical patterns of a place: the two words before it ("2 a b"), the one before it ("1 b") and the one after it ("n c").
    What stands before a place inside a word, or touches one after it, is no pattern."""
    pieces = lambda b: F.regexp_extract_all(b, F.lit(_PIECE), F.lit(0))
    near = F.substring(text, F.greatest(F.lit(1), start - REACH + 1), F.least(start, F.lit(REACH)))
    # Of three words in reach the last two are whole.
    whole = lambda ws: F.when((F.size(ws) >= 3) | (start <= REACH), ws).otherwise(pieces(F.substring(text, F.lit(1), start)))
    last = lambda ws, k: _norm(F.get(ws, F.size(ws) - k))
    two = lambda ws: F.when(F.size(ws) >= 2, F.array(F.concat(F.lit("2 "), last(ws, 2), F.lit(" "), last(ws, 1)), F.concat(F.lit("1 "), last(ws, 1)))).when(F.size(ws) == 1, F.array(F.concat(F.lit("1 "), last(ws, 1)))).otherwise(_none())
    before = let(near, lambda b: F.when(b.rlike(f"[{_SPACE}{_MARKS}]$"), let(pieces(b), lambda ws: let(whole(ws), two))).otherwise(_none()))
    far = lambda n: F.substring(text, end + 1, n)
    cut_off = lambda w: (F.char_length(F.regexp_extract(w, _NEXT, 0)) == REACH) | ~w.rlike(f"[^{_SPACE}{_MARKS}]")
    said = lambda w: let(_norm(F.regexp_extract(w, _NEXT, 1)), lambda x: F.when(x != "", F.array(F.concat(F.lit("n "), x))).otherwise(_none()))
    after = let(far(F.lit(REACH)), lambda w: F.when((F.char_length(w) == REACH) & cut_off(w), said(far(F.char_length(text)))).otherwise(said(w)))
    return F.concat(before, after)


def word_contexts(text: Column) -> Column:
    """All patterns that a text's words make for what stands before or after them, each as often as it occurs."""
    some = lambda ws, least, made: F.when(F.size(ws) > least, made).otherwise(_none())
    pairs = lambda ws: F.concat(
        some(ws, 2, F.transform(F.slice(ws, 1, F.greatest(F.lit(0), F.size(ws) - 2)), lambda w, i: F.concat(F.lit("2 "), w, F.lit(" "), F.get(ws, i + 1)))),
        some(ws, 1, F.transform(F.slice(ws, 1, F.greatest(F.lit(0), F.size(ws) - 1)), lambda w: F.concat(F.lit("1 "), w))),
        some(ws, 1, F.transform(F.slice(ws, 2, F.size(ws)), lambda w: F.concat(F.lit("n "), w))),
    )
    return let(F.regexp_extract_all(_norm(text), F.lit(_PIECE), F.lit(0)), pairs)


def personal_spans(docs: DataFrame, rounds: int = 3, min_support: int = 5, min_precision: float = 0.5, min_score: float = 0.8, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id, spans (array of start, rank, kind, end), and keep's columns.

    The BASE spans are the seeds. Words before and after a seed or token make lexical patterns (see contexts()); patterns and
    the identifier-like tokens (five characters or more, three digits or more, outside BASE spans) beside them form a graph. Each round scores a pattern by the share of all its
    occurrences in the corpus that are beside a seed or an accepted instance; it counts if min_support different ones are, and
    from min_precision on (patterns that cannot reach that, whatever is accepted, are left out beforehand). An instance scores
    1 minus the product of (1 - score) over its patterns; instances of min_score or more are accepted and count from the next
    round on. Spans of the accepted instances beside a pattern that counts are added, as kind "found".
    BASE spans always stay. Null text: empty, no spans. Repeated rows keep their own spans, but instances and supports count
    different values, so copies of one document make no pattern. Nothing is collected: patterns and instances are tables, and
    a pattern's occurrences are counted by partial sums."""
    with passing(docs.sparkSession) as made:
        return _personal_spans(made, docs, rounds, min_support, min_precision, min_score, id_col, text_col, keep)


def _personal_spans(made, docs, rounds, min_support, min_precision, min_score, id_col, text_col, keep) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,match:string,value:string>>")
    seeds = all_spans(text, BASE)
    inside = lambda s, a: F.exists(a, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    found = let(seeds, lambda a: F.concat(a, F.filter(F.coalesce(kind_spans(text, _TOKEN, len(BASE)), none), lambda s: ~inside(s, a))))
    full = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(s["match"]).alias("inst"), contexts(text, s["start"], s["end"]).alias("pats")))
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(F.lit(0).alias("_"), *keep).alias("_keep"), full.alias("_found"))
    rows = kept(cut(rows.withColumn("_row", F.monotonically_increasing_id()), "personal-seeds"), made)
    some = rows.filter(F.size("_found") > 0).select("_row", F.explode("_found").alias("s")).select("_row", "s.*")
    edges = some.select("inst", (F.col("kind") != _TOKEN.name).alias("seed"), F.explode("pats").alias("pat"))
    edges = cut(edges.groupBy("pat", "inst", "seed").agg(F.count("*").alias("n")), "personal-graph")
    hopeful = edges.groupBy("pat").agg(F.count_distinct("inst").alias("k"), F.bool_or(~F.col("seed")).alias("new"))
    hopeful = cut(hopeful.filter((F.col("k") >= min_support) & F.col("new")).select("pat"), "personal-patterns")
    accepted = None
    if not hopeful.isEmpty():
        # How often a pattern occurs: first where any span can be, which already rules out most, then over the whole corpus.
        most = edges.groupBy("pat").agg(F.sum("n").alias("n"))
        for where in (text.rlike("(?s)@|[0-9].*[0-9].*[0-9]"), F.lit(True)):
            said = docs.filter(where).select(F.explode(word_contexts(text)).alias("pat"))
            total = join_counted(said, hopeful, "pat", "inner").groupBy("pat").agg(F.count("*").alias("total"))
            total = cut(total.join(most, "pat").filter(F.col("n") >= min_precision * F.col("total")).select("pat", "total"), "personal-totals")
            hopeful = total.select("pat")
            if hopeful.isEmpty():
                break
        graph = cut(edges.join(total, "pat"), "personal-graph")
        known = graph.filter("seed").select("inst").distinct()
        for _ in range(rounds):
            marked = graph.join(known.withColumn("_known", F.lit(True)), "inst", "left").withColumn("_good", F.col("seed") | F.coalesce("_known", F.lit(False)))
            score = F.sum(F.when(F.col("_good"), F.col("n")).otherwise(0)) / F.first("total")
            pats = marked.groupBy("pat").agg(score.alias("score"), F.count_distinct(F.when(F.col("_good"), F.col("inst"))).alias("k")).filter((F.col("k") >= min_support) & (F.col("score") >= min_precision)).select("pat", F.least("score", F.lit(0.999)).alias("score"))
            pats = cut(pats, "personal-scores")
            insts = graph.join(pats, "pat").groupBy("inst").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("conf")).filter(F.col("conf") >= min_score).select("inst")
            known = cut(known.union(insts).distinct(), "personal-known")
        good = graph.filter("not seed").join(pats, "pat").join(known, "inst").select("pat", "inst")
        accepted = kept(cut(good.distinct(), "personal-accepted"), made)
    plain = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = rows.withColumn("spans", plain(F.filter("_found", lambda s: s["kind"] != _TOKEN.name)))
    if accepted is not None:
        # Only rows with tokens can gain spans; the others are not shuffled.
        tokens = F.exists("_found", lambda s: s["kind"] == _TOKEN.name)
        hits = some.filter(F.col("kind") == _TOKEN.name).select("_row", "start", "rank", "kind", "end", "inst", F.explode("pats").alias("pat"))
        hits = join_counted(hits, accepted, ["pat", "inst"], "inner").groupBy("_row").agg(F.collect_set(F.struct("start", "rank", "kind", "end")).alias("_more"))
        more = out.filter(tokens).join(hits, "_row", "left").withColumn("spans", F.array_sort(F.concat("spans", F.coalesce("_more", plain(F.array().cast(rows.schema["_found"].dataType)))))).drop("_more")
        out = out.filter(~tokens).unionByName(more)
    return out.select(F.col("_id").alias(id_col), "spans", *[F.col(f"_keep.{c}").alias(c) for c in keep])


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the joined places of personal_spans()'s spans: one row for each of its rows. No spans: zeros and empty joins;
    null ids pass through."""
    base = F.filter("spans", lambda s: s["kind"] != _TOKEN.name)
    return spans.select(id_col, *[counted(F.col("spans"), k.name).alias(f"n_{k.name}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), counted(F.col("spans"), _TOKEN.name).alias("n_found"))
