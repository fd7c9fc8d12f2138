"""Token counts of a byte-fallback BPE vocabulary by a finite-state transducer.

The vocabulary is compiled into a deterministic transducer over code points. Its transitions carry the number of tokens
that reading one more code point adds to (or, when a merge joins what stood apart, takes from) the count of the text so
far. It rests on two facts of BPE with one rank for each piece: the encoding of a prefix ends in exactly one token t, what
stands before t is the encoding of the shorter prefix, and a sequence is an encoding exactly if all its adjacent pairs are.
A state holds, for each suffix that can still grow into a piece, the token the text before that suffix ends in (None where
no piece could span the seam) and its count relative to now; there are finitely many. States and transitions are compiled
when a text first needs them and kept in a table of bounded size; words between spaces are transitions of their own, from
the state at a space to the next one, which no piece spans.

A chunk of text is a state map: entry state -> (exit state, tokens added). Its entry states are those that the LOOK code
points before it allow: exactly one if two of them stand together in no piece, else one for each place at which an
encoding may have begun there. Maps compose associatively, and scan() composes them by doubling. If the entry state that
the scan brings to a chunk is not in its map, which a text would have to be made for, the map is extended by it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, ship

#: Code points of a chunk, and before it that are looked at. Texts of more than SPREAD go to several tasks.
CHUNK, LOOK, SPREAD = 1 << 16, 32, 1 << 18
#: States, and words whose counts are remembered, before the tables are begun anew (bounded memory).
MAX_STATES, MAX_WORDS = 200_000, 300_000
_UNIT, _SPACE = re.compile(" *[^ ]+| +"), re.compile("(?<=[^ ]) ")

Key = tuple[tuple[str, str | None, int], ...]
ChunkMap = dict[Key, tuple[Key, int]]
START: Key = (("", None, 0),)


class Transducer:
    """ranks: piece (space as itself) -> rank, lower merges first."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks, self.pairs = ranks, {}
        self.prefixes = {p[:i] for p in ranks for i in range(1, len(p) + 1)}
        self.inner = {p[i : i + 2] for p in ranks for i in range(len(p) - 1)}
        self.begin()

    def begin(self) -> None:
        self.ids, self.states, self.moves = {START: 0}, [START], [{}]

    def state(self, key: Key) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.ids[key]

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the best-ranked, then leftmost, pair merges first."""
        parts = list(text)
        while True:
            best = min(((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def fits(self, before: str | None, token: str) -> bool:
        """Whether token may follow before (None: nothing that could merge with it)."""
        key = (before, token)
        if key not in self.pairs:
            if len(self.pairs) >= MAX_WORDS:
                self.pairs.clear()
            self.pairs[key] = self.merged((before or "") + token) == ([before] if before else []) + [token]
        return self.pairs[key]

    def compiled(self, state: int, char: str) -> tuple[int, int]:
        """Next state and tokens added, entered into the table."""
        if char not in self.ranks:  # falls back to its bytes, and nothing merges across it
            move = 0, len(char.encode("utf-8", "surrogatepass"))
        else:
            own = [(s + char, b if b is None or b[-1] + (s + char)[0] in self.inner else None, n) for s, b, n in self.states[state]]
            token, added = next((s, n + 1) for s, before, n in own if s in self.ranks and self.fits(before, s))
            grown = [(s, before, n - added) for s, before, n in own if s in self.prefixes]
            move = self.state((*grown, ("", token, 0))), added
        self.moves[state][char] = move
        return move

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """Exit state and tokens added."""
        total = 0
        for char in text:
            state, added = self.moves[state].get(char) or self.compiled(state, char)
            total += added
        return state, total


class Words(dict):
    """word -> tokens that a space and that word add, from one space to the next."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        n = self.transducer.run(" " + word)[1]
        if len(word) <= 64:
            self[word] = n
        return n


def compose(a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """The map of a's text followed by b's, where b's map has a's exit."""
    return {entry: (b[out][0], n + b[out][1]) for entry, (out, n) in a.items() if out in b}


def scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """Inclusive prefix scan by doubling: after step k each map covers 2**k chunks."""
    step = 1
    while step < len(maps):
        maps = [m if i < step else compose(maps[i - step], m) for i, m in enumerate(maps)]
        step *= 2
    return maps


def scanned(maps: list[ChunkMap]) -> tuple[int | None, int, Key]:
    """Tokens of the whole text; if None, the chunk whose map lacks an entry state, and that state."""
    done = scan(maps)
    if START in done[-1]:
        return done[-1][START][1], 0, START
    at = next(i for i, m in enumerate(done) if START not in m)
    return None, at, done[at - 1][START][0]


class Counter:
    def __init__(self, ranks: dict[str, int]):
        self.transducer = Transducer(ranks)
        self.words = Words(self.transducer)

    def units(self, text: str) -> int:
        """Tokens from one space after another character to another such space."""
        if "  " not in text:
            return sum(map(self.words.__getitem__, text[1:].split(" ")))
        return sum(self.transducer.run(u)[1] for u in _UNIT.findall(text))

    def advance(self, state: int, text: str) -> tuple[int, int]:
        """Exit state and tokens added: by words where spaces part them."""
        first = _SPACE.search(text)
        if not first:
            return self.transducer.run(text, state)
        last = text.rindex(" ")
        while text[last - 1] == " ":
            last -= 1
        n = self.transducer.run(text[: first.start()], state)[1]
        n += self.units(text[first.start() : last]) if last > first.start() else 0
        out, more = self.transducer.run(text[last:])
        return out, n + more

    def entries(self, before: str) -> list[Key]:
        """States that a chunk may be entered in, from the code points before it; none before: the start."""
        t = self.transducer
        if not before:
            return [START]
        seams = [i for i in range(1, len(before)) if before[i - 1 : i + 1] not in t.inner]
        return list(dict.fromkeys(t.states[t.run(before[i:])[0]] for i in (seams[-1:] or range(len(before)))))

    def chunk_map(self, chunk: str, entries: Iterable[Key]) -> ChunkMap:
        t = self.transducer
        if len(t.states) > MAX_STATES:
            t.begin()
        out: ChunkMap = {}
        for entry in entries:
            state, n = self.advance(t.state(entry), chunk)
            out[entry] = t.states[state], n
        return out

    def count(self, text: str, chunk: int = CHUNK, look: int = LOOK) -> int:
        """Tokens of a text: the prefix scan's last value, from the start state."""
        if not text:
            return 0
        maps = [self.chunk_map(part, self.entries(before)) for part, before in chunks(text, chunk, look)]
        while True:
            total, at, entry = scanned(maps)
            if total is not None:
                return total
            maps[at] |= self.chunk_map(prepared(text)[at * chunk : (at + 1) * chunk], [entry])


def prepared(text: str) -> str:
    """The text as the vocabulary sees it: a space before it, and the space mark as a space."""
    return (" " + text).replace("▁", " ")


def chunks(text: str, chunk: int = CHUNK, look: int = LOOK) -> Iterator[tuple[str, str]]:
    """Chunks of a text and what stands before each."""
    text = prepared(text)
    for i in range(0, len(text), chunk):
        yield text[i : i + chunk], text[max(0, i - look) : i]


@lru_cache(maxsize=2)
def counter(model: str) -> Counter:
    """model: a sentencepiece BPE model file whose normaliser is the identity, with a leading space and byte fallback."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    usable = (i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i)))
    return Counter({p.id_to_piece(i).replace("▁", " "): -p.get_score(i) for i in usable})


def _sent(key: Key) -> str:
    return json.dumps(key)


def _read(text: str) -> Key:
    return tuple(map(tuple, json.loads(text)))


def token_counts(docs: DataFrame, model: str, limit: int = 4096, chunk: int = CHUNK, look: int = LOOK, spread: int = SPREAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; null ids pass through; repeated rows give repeated rows; other columns
    are not read. Texts up to `spread` code points are counted where they are read, chunk by chunk; of longer ones, which alone
    are shuffled, the chunks' maps are made in tasks of their own and scanned together. model must name the same file on every
    executor."""
    spark = ship(docs.sparkSession)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        c = counter(model)
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "n_tokens": [c.count(t, chunk, look) for t in b["_text"]], "n_bytes": b["_bytes"]})

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("_bytes"))
    long = F.char_length("_text") > spread
    out = rows.filter(~long).mapInPandas(counted, "_id string, n_tokens long, n_bytes long")
    out = out.unionByName(_spread(spark, rows.filter(long), model, chunk, look))
    return out.select(F.col("_id").cast(kind).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _spread(spark: SparkSession, rows: DataFrame, model: str, chunk: int, look: int) -> DataFrame:
    """_id, n_tokens, n_bytes of texts whose chunks are dealt to different tasks."""

    def parted(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            for row, i, text, n in zip(b["_row"], b["_id"], b["_text"], b["_bytes"]):
                for at, (part, before) in enumerate(chunks(text, chunk, look)):
                    yield pd.DataFrame({"_row": [row], "at": [at], "_id": [i], "n_bytes": [n], "part": [part], "before": [before]})

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        c = counter(model)
        for b in batches:
            for row, at, part, before, entry in zip(b["_row"], b["at"], b["part"], b["before"], b["entry"]):
                made = c.chunk_map(part, [_read(entry)] if entry else c.entries(before))
                yield pd.DataFrame([(row, at, _sent(e), _sent(x), n) for e, (x, n) in made.items()], columns=["_row", "at", "entry", "out", "n"])

    def folded(part: pd.DataFrame) -> pd.DataFrame:
        maps: list[ChunkMap] = [{} for _ in range(part["at"].max() + 1)]
        for at, entry, out, n in zip(part["at"], part["entry"], part["out"], part["n"]):
            maps[at][_read(entry)] = _read(out), n
        total, at, entry = scanned(maps)
        return pd.DataFrame({"_row": [part["_row"].iloc[0]], "n_tokens": pd.array([total], "Int64"), "at": [at], "entry": [_sent(entry)]})

    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    parts = numbered.mapInPandas(parted, "_row long, at int, _id string, n_bytes long, part string, before string")
    parts = cut(parts.repartition("_row", "at"), "token-chunks")
    if parts.isEmpty():
        return spark.createDataFrame([], "_id string, n_tokens long, n_bytes long")
    maps, asked = None, parts.withColumn("entry", F.lit(None).cast("string"))
    while True:
        made = cut(asked.mapInPandas(mapped, "_row long, at int, entry string, out string, n long"), "token-maps")
        maps = made if maps is None else maps.unionByName(made)
        totals = cut(maps.groupBy("_row").applyInPandas(folded, "_row long, n_tokens long, at int, entry string"), "token-totals")
        lacking = totals.filter("n_tokens is null").select("_row", "at", "entry")
        asked = parts.join(lacking, ["_row", "at"])
        if lacking.isEmpty():
            return parts.filter("at = 0").select("_row", "_id", "n_bytes").join(totals.select("_row", "n_tokens"), "_row").select("_id", "n_tokens", "n_bytes")
