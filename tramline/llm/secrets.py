"""Secret scan with corpus-wide ownership frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, join_counted, kept, passing
from .spans import Kind, all_spans, counted, joined

BASE = [
    Kind("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, lambda m, v: F.char_length(v) >= 12, "[:=]"),
    Kind("access", "AKIA[A-Z0-9]{14,}", maybe="AKIA"),
    Kind("hex", "[0-9a-f]{16,}+"),
]


def _live_looking(m: Column, v: Column) -> Column:
    """Upper case, lower case and digits, and many different characters: random rather than written."""
    varied = F.size(F.array_distinct(F.split(m, "")))
    return m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9].*[0-9].*[0-9]") & (varied >= 12)


#: Candidates of no known form; only ownership tells live ones from examples.
LIVE = Kind("live", "[A-Za-z0-9+/_=-]{20,}+", 0, _live_looking, "[A-Za-z0-9+/_=-]{20}")


def secret_spans(docs: DataFrame, max_owners: int = 1, max_repos: int = 3, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("lang",), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id, spans (array of start, rank, kind, end, n_repos, n_owners, n_uses, verdict), keep's columns.

    Candidates are the BASE kinds' values and random-looking tokens (LIVE). Their SHA-256 hashes are aggregated over the whole
    corpus by distinct repositories (repo_cols within an owner) and owners. A hash of at most max_owners owners and max_repos
    repositories is "specific" to its owner and taken for live; one that more share is "copied", a spread example. BASE spans
    always stay, with their verdict; LIVE ones only if specific and not inside a BASE span.

    Null text: empty. Null owner or repository: one of its own. Null ids pass through. Repeated rows each keep their spans.
    Hashes, not values, are written and shuffled; a hot hash is counted by partial sums, first by repository, then by owner,
    and joined by broadcast or a split join. Rows without a candidate are not shuffled."""
    with passing(docs.sparkSession) as made:
        return _secret_spans(made, docs, max_owners, max_repos, id_col, text_col, owner_col, repo_cols, keep)


def _secret_spans(made, docs, max_owners, max_repos, id_col, text_col, owner_col, repo_cols, keep) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    tag = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(c).cast("string")))
    found = F.transform(all_spans(text, [*BASE, LIVE]), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("h")))
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(F.lit(0).alias("_"), *keep).alias("_keep"), tag(owner_col).alias("_owner"), F.to_json(F.struct(*[tag(c).alias(c) for c in repo_cols])).alias("_repo"), found.alias("_found"))
    rows = kept(cut(rows.withColumn("_row", F.monotonically_increasing_id()), "secret-candidates"), made)
    some = rows.filter(F.size("_found") > 0)
    each = some.select("_row", "_owner", "_repo", F.explode("_found").alias("s")).select("_row", "_owner", "_repo", "s.*")
    repos = each.groupBy("h", "_owner", "_repo").agg(F.count("*").alias("n"))
    owners = repos.groupBy("h", "_owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    owned = kept(cut(owners.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"), F.sum("n").alias("n_uses")), "secret-owners"), made)
    specific = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    judged = join_counted(each, owned, "h").withColumn("verdict", F.when(specific, "specific").otherwise("copied"))
    span = F.struct("start", "rank", "kind", "end", "n_repos", "n_owners", "n_uses", "verdict")
    spans = judged.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType).alias("spans")
    out = some.select("_row", "_id", "_keep").join(spans, "_row").unionByName(rows.filter(F.size("_found") == 0).select("_row", "_id", "_keep", none))
    base = F.filter("spans", lambda s: s["kind"] != LIVE.name)
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    out = out.withColumn("spans", F.filter("spans", lambda s: (s["kind"] != LIVE.name) | ((s["verdict"] == "specific") & apart(s))))
    return out.select(F.col("_id").alias(id_col), "spans", *[F.col(f"_keep.{c}").alias(c) for c in keep])


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the joined places of secret_spans()'s spans, and each one's verdict: one row for each of its rows. No spans:
    zeros and empty joins; null ids pass through."""
    base = F.filter("spans", lambda s: s["kind"] != LIVE.name)
    verdicts = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"], s["verdict"])), ",")
    judged = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return spans.select(id_col, *[counted(F.col("spans"), k.name).alias(f"n_{k.name}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), counted(F.col("spans"), LIVE.name).alias("n_live"), judged("specific").alias("n_specific"), judged("copied").alias("n_copied"), verdicts.alias("verdicts"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each run of overlapping spans replaced by mark; text, null too, as it is if there are none."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    till = lambda a, s: F.substring(text, a["at"] + 1, s["start"] - a["at"])
    step = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], till(a, s), F.lit(mark))).otherwise(a["out"]).alias("out"))
    end = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text)
