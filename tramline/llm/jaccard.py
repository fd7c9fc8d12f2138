"""N-gram Jaccard self-join by size-aware heavy and light sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, drop, join_counted, kept, passing, ship
from .components import components
from .sketch import summed
from .substrings import NULL_ID
from .textblocks import Words, arrow_rows, blocks, mix, spans_hash

#: Bits of the number of cells of the frequency sketch: about one for CELL_BYTES of text, between these. A count is kept as
#: eighths of its logarithm, in one byte that no count fills.
CELL_BITS, CELL_BYTES = (20, 24), 256
#: Cells of it that the driver works on at a time.
CELLS_AT_ONCE = 1 << 20
#: Sets up to MAX_SMALL may be enumerated. Lists that would make more than LONG pairs of sets are parted by further elements
#: first, DEPTH times at most.
MAX_SMALL, LONG, DEPTH = 24, 1 << 22, 3


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each different k-word shingle, sorted; a shorter text's words are one shingle."""
    start, h = words.windows(k)
    short = np.nonzero((words.counts > 0) & (words.counts < k))[0]
    whole = spans_hash(words.hashes[0], words.first[short], words.first[short + 1])
    doc, h = np.concatenate([words.doc[start], short]), np.concatenate([h, whole])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    return doc[new], h[new]


def _least(n, percent: int):
    """Least overlap with anything that a set of n elements can link with."""
    return -(-percent * n // 100)


def enumerated(n: int, percent: int) -> int:
    return sum(comb(n, i) for i in range(n - _least(n, percent) + 1))


def _slices(n: int) -> Iterator[slice]:
    """Of an array that the driver has, what it works on at a time, so that no copy of all of it is made."""
    return (slice(lo, lo + CELLS_AT_ONCE) for lo in range(0, n, CELLS_AT_ONCE))


def log_classes(seen: np.ndarray) -> np.ndarray:
    """Counts by classes, eight to a doubling."""
    logs = np.empty(len(seen), np.uint8)
    for own in _slices(len(seen)):
        logs[own] = (8 * np.log2(seen[own].astype(np.float32) + 1)).astype(np.uint8)
    return logs


def rare_length(seen: np.ndarray, logs: np.ndarray, share: float) -> float:
    """Mean length of the lists of the rarest `share` of all elements' occurrences, which are those that prefixes hold; logs:
    seen's counts by classes."""
    held, cells = np.zeros(256), np.zeros(256, np.int64)
    for own in _slices(len(seen)):
        held += np.bincount(logs[own], seen[own].astype(np.float32), 256)
        cells += np.bincount(logs[own], minlength=256)
    cells = np.maximum(1, cells)
    before = np.concatenate([[0], np.cumsum(held)[:-1]])
    taken = np.clip(share * held.sum() - before, 0, held)
    return float((taken * held / cells).sum() / max(1.0, taken.sum()))


def boundary(list_length: float, percent: int) -> int:
    """Largest size up to which enumerating subsets costs no more than scanning the lists of a set's prefix."""
    best = 0
    for n in range(1, MAX_SMALL + 1):
        if enumerated(n, percent) > (n - _least(n, percent) + 1) * max(1.0, list_length):
            break
        best = n
    return best


def _linkable(n1: Column, p1: Column, n2: Column, p2: Column, percent: int, before: int = 0) -> Column:
    """Whether sets of these sizes can still link, whose next common element, after `before` others, is at these places."""
    most = F.least(n1 - p1, n2 - p2) + before
    return (100 * most >= percent * (n1 + n2 - most)) & (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))


def similar_groups(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id.

    A document's set: its different k-word shingles, A-Z in lower case. Two link if 100 * intersection >= percent * union;
    component_id is the least id that links reach, the row's own included.

    Equal sets are one class. Sets up to a boundary size are light: each enumerates its subsets of every size that a link may
    have in common; sets that share a subset of t elements form a star around the smallest of them, which links with all that
    any of them links with over it. Larger ones are heavy: elements are ordered by corpus frequency (from a sketch of bounded
    size, whose noise only blurs the order of what is rarer than that; any fixed order is right), and the inverted lists of
    the first ones are scanned, as linked sets must meet in one. The boundary is where enumeration would cost more than the lists, by their mean length.
    A list is first joined with its most typical member only, so a group of copies is linked by a star. Exact sets are compared.
    Only members that the star did not bring into its component are then joined with the rest of their list, so all links
    between different components are found, and pairs within one are not formed. A long list is first parted by the next
    element that its members may have in common, and again while its parts are long (see crossing()). Size and place filters
    drop pairs that cannot link. Lists are keys of joins that Spark may split; nothing is collected but the sketch.

    Null or empty text, or no words: 0 shingles, linked with nothing, component_id its own id. Null ids are never a
    component_id while another id is there. Repeated rows are in one class. Other columns are not read."""
    with passing(docs.sparkSession) as made:
        return _similar_groups(made, docs, k, percent, id_col, text_col)


def crossing(lists: DataFrame, prefixes: DataFrame, percent: int, small: int) -> DataFrame:
    """lists(token, cls, n, p, comp, apart): pairs (a, b) of one list, of different components, one of them apart.

    If the members that are apart make more than LONG pairs with the others, all are dealt out once more: two of them that link and have their first common element
    here have the next one within one place more of their order's beginning, so they meet in a list of both. prefixes(cls,
    prefix) has the elements in order. After DEPTH such steps lists are joined whatever their length, so none is left out."""
    out = []
    for level in range(1, DEPTH + 2):
        sized = lists.groupBy("token").agg(F.sum(F.col("apart").cast("int")).alias("_a"), F.count("*").alias("_m"), F.min("comp").alias("_l"), F.max("comp").alias("_h")).filter("_a > 0 and _l < _h")
        sized = cut(sized.select("token", (F.lit(level <= DEPTH) & (F.col("_a") * F.col("_m") > LONG)).alias("long")), "set-sizes")
        lists = cut(join_counted(lists, sized, "token", "inner"), "set-parts")
        short = lists.filter(~F.col("long"))
        one = short.filter("apart").select("token", F.col("cls").alias("acls"), F.col("n").alias("an"), F.col("p").alias("ap"), F.col("comp").alias("acomp"))
        both = one.join(short, "token").filter((F.col("comp") != F.col("acomp")) & (F.greatest("n", "an") > small) & _linkable(F.col("n"), F.col("p"), F.col("an"), F.col("ap"), percent, level - 1))
        out.append(cut(both.select(F.least("cls", "acls").alias("a"), F.greatest("cls", "acls").alias("b")).distinct(), "set-crossing"))
        long = lists.filter("long")
        if long.isEmpty():
            break
        last = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + level
        more = long.join(prefixes, "cls").select("token", "cls", "n", "p", "comp", "apart", F.posexplode(F.slice("prefix", F.col("p") + 2, F.greatest(F.lit(0), last - F.col("p")).cast("int"))).alias("q", "next"))
        lists = more.select(F.xxhash64("token", "next").alias("token"), "cls", "n", (F.col("p") + 1 + F.col("q")).alias("p"), "comp", "apart")
    return reduce(DataFrame.union, out).distinct()


def _similar_groups(made, docs, k, percent, id_col, text_col) -> DataFrame:
    spark = ship(docs.sparkSession)
    ident, text = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # A row is known by a hash of id and text, as ids may repeat or be null.
    rows = docs.select(ident.alias("doc"), F.xxhash64(ident, text).alias("key"), text.alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    cells = 1 << min(CELL_BITS[1], max(CELL_BITS[0], (n_bytes // CELL_BYTES).bit_length()))

    def count(acc: np.ndarray, words: Words) -> None:
        at, n = np.unique(shingle_sets(words, k)[1] % np.uint64(cells), return_counts=True)
        acc[at.astype(np.int64)] += n.astype(np.uint32)

    seen = summed(rows, F.col("text"), cells, count, lower=True, kind=np.uint32)
    logs = log_classes(seen)
    small = boundary(rare_length(seen, logs, 1 - percent / 100), percent)
    sketch = spark.sparkContext.broadcast(logs)
    del seen

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, words in blocks((((d, i), t) for d, i, t in arrow_rows(batches)), lower=True):
            doc, h = shingle_sets(words, k)
            df = sketch.value[(h % np.uint64(cells)).astype(np.int64)]
            n = np.bincount(doc, minlength=len(ids))
            first = np.concatenate([[0], np.cumsum(n)])
            some = n > 0
            at = first[:-1][some]
            s1, s2, typ = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids))
            if len(at):
                s1[some] = np.add.reduceat(mix(h), at).view(np.int64)
                s2[some] = np.bitwise_xor.reduceat(mix(h + np.uint64(77)), at).view(np.int64)
                typ[some] = np.add.reduceat(df.astype(float), at) / n[some]
            order = np.lexsort((h, df, doc))
            place = np.arange(len(h)) - first[doc]
            prefix = order[place < (n - _least(n, percent) + 1 + DEPTH)[doc]]
            few = (n <= MAX_SMALL)[doc]
            lists = []
            for picked in (prefix, np.nonzero(few)[0]):
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[picked], minlength=len(ids)))])
                lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[picked].view(np.int64))))
            own = [pa.array(x, pa.int64()) for x in zip(*ids)]
            cols = [*own, pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), pa.array(typ), *lists]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "key", "n", "s1", "s2", "typ", "prefix", "elements"])

    sets_ = rows.mapInArrow(summaries, "doc long, key long, n long, s1 long, s2 long, typ double, prefix array<long>, elements array<long>")
    sets_ = cut(sets_, "sets")
    classes = sets_.filter("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("doc", "key", "n", "typ", "prefix", "elements")).alias("c"), F.min(F.when(F.col("doc") != NULL_ID, F.col("doc"))).alias("top"))
    classes = cut(classes.select(F.col("s1").alias("cls"), "c.*", "top"), "set-classes")
    members, firsts = kept(cut(sets_.select("doc", "n", "s1"), "set-members"), made), cut(classes.select("cls", "key", "top"), "set-firsts")
    drop(sets_)

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cls, n, elements in arrow_rows(batches):
            parts = mix(np.array(elements, np.int64).view(np.uint64))
            total, subs, sizes = parts.sum(dtype=np.uint64), [], []
            for out in range(n - int(_least(n, percent)) + 1):
                gone = np.array(list(combinations(range(n), out)), np.int64).reshape(comb(n, out), out)
                subs.append(total - parts[gone].sum(axis=1, dtype=np.uint64))
                sizes.append(np.full(len(gone), n - out))
            sub = mix(np.concatenate(subs)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sub), pa.array(np.concatenate(sizes)), pa.array(np.full(len(sub), cls)), pa.array(np.full(len(sub), n))], ["sub", "t", "cls", "n"])

    light = classes.filter(F.col("n") <= small).select("cls", "n", "elements").mapInArrow(subsets, "sub long, t long, cls long, n long")
    light = cut(light, "set-subsets")
    stars = light.groupBy("sub", "t").agg(F.min(F.struct("n", "cls")).alias("hub"), F.count("*").alias("m")).filter("m > 1").select("sub", "t", F.col("hub.n").alias("hn"), F.col("hub.cls").alias("hcls"))
    stars = cut(stars, "set-stars")
    linked = light.join(stars, ["sub", "t"]).filter((F.col("cls") != F.col("hcls")) & (100 * F.col("t") >= percent * (F.col("n") + F.col("hn") - F.col("t"))))
    edges = cut(linked.select(F.col("cls").alias("a"), F.col("hcls").alias("b")).distinct(), "set-links")
    drop(light, stars)

    least = _least(small + 1, percent)
    heavy = classes.filter(F.col("n") >= least).select("cls", "n", "typ", F.posexplode("prefix").alias("p", "token"))
    heavy = heavy.filter(F.col("p") <= F.col("n") - F.floor((percent * F.col("n") + 99) / 100))
    shared = cut(heavy.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token"), "set-tokens")
    lists = cut(heavy.join(shared, "token"), "set-lists")
    drop(shared)
    hubs = lists.groupBy("token").agg(F.max(F.struct("typ", "cls", "n", "p")).alias("hub"))
    hubs = cut(hubs.select("token", F.col("hub.cls").alias("hcls"), F.col("hub.n").alias("hn"), F.col("hub.p").alias("hp")), "set-hubs")
    big = F.greatest("n", "hn") > small
    pairs = lists.join(hubs, "token").filter((F.col("cls") != F.col("hcls")) & big & _linkable(F.col("n"), F.col("p"), F.col("hn"), F.col("hp"), percent))
    pairs = cut(pairs.select(F.col("cls").alias("a"), F.col("hcls").alias("b")).distinct(), "set-pairs")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, words in blocks((((c, x), t) for c, x, t in arrow_rows(batches)), lower=True):
            doc, h = shingle_sets(words, k)
            edges_ = np.searchsorted(doc, np.arange(len(ids) + 1))
            own = [h[a:b] for a, b in zip(edges_[:-1], edges_[1:])]
            good = [i for i, (s, (c, _)) in enumerate(zip(own, ids)) if int(mix(s).sum(dtype=np.uint64).view(np.int64)) == c]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i][0] for i in good], pa.int64()), pa.array([own[i].tobytes() for i in good], pa.binary())], ["cls", "items"])

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * same >= percent * (len(x) + len(y) - same):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Of the pairs of classes, those that link by their exact sets, which are made anew from one document of each class."""
        need = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        need = cut(need.join(firsts.select("cls", "key"), "cls"), "set-needed")
        found = join_counted(rows, need, "key", "inner").select("cls", "key", "text").mapInArrow(sets, "cls long, items binary")
        found = cut(found.groupBy("cls").agg(F.first("items").alias("items")), "set-items")
        both = pairs.join(found.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a").join(found.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
        out = cut(both.select("a", "b", "x", "y").mapInArrow(overlaps, "a long, b long"), "set-links")
        drop(need, found)
        return out

    edges = edges.union(verified(pairs))
    comp = components(edges)
    hubs = hubs.join(comp.withColumnRenamed("node", "hcls"), "hcls", "left").select("token", F.coalesce("comp", "hcls").alias("hcomp"))
    hubs = cut(hubs, "set-hubs")
    lists = lists.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    lists = join_counted(lists, hubs, "token").select("token", "cls", "n", "p", "comp", (F.col("comp") != F.col("hcomp")).alias("apart"))
    cross = crossing(lists, classes.select("cls", "prefix"), percent, small)
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = cut(cross.join(tried, ["a", "b"], "left_anti"), "set-pairs")
    if not cross.isEmpty():
        comp = components(edges.union(verified(cross)))
    full = firsts.select("cls", "top").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    tops = cut(full.groupBy("comp").agg(F.min("top").alias("component_id")), "set-tops")
    ends = kept(cut(full.join(tops, "comp").select(F.col("cls").alias("s1"), "component_id"), "set-ends"), made)
    back = F.when(F.col("doc") != NULL_ID, F.col("doc"))
    out = join_counted(members.select("doc", "n", F.when(F.col("n") > 0, F.col("s1")).alias("s1")), ends, "s1")
    return out.select(back.cast(dict(docs.dtypes)[id_col]).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(back).alias("component_id"))


ORACLE = """
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = w.doc_id
"""
