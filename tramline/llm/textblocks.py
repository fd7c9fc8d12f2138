"""Words and word windows of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
_ODD = lambda: np.uint64(int(_rng.integers(1, 1 << 63)) | 1)
_BASES = [_ODD(), _ODD()]
_BYTES = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) for _ in range(2)]
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes that are hashed at a time (what numpy holds for them is about 60 times that), and of texts that go together.
BLOCK, GROUP = 1 << 17, 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each value's bits over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**0 .. B**(n-1) modulo 2**64 and their inverses."""
    held = _POWERS.get(which)
    if held is None or len(held[0]) < n:
        size, out = max(n, BLOCK + 1024), []
        for base in (int(_BASES[which]), pow(int(_BASES[which]), -1, 1 << 64)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        held = _POWERS[which] = tuple(out)
    return held


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of values[start:end] for each pair, by one running sum of values times powers."""
    up, down = powers(which, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_places(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in data; bounds: where texts begin and end, which words don't cross."""
    word = ~_SEP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
    after = np.concatenate([word[1:], [False]]) & ~edge[1:]
    return np.nonzero(word & ~before)[0], np.nonzero(word & ~after)[0] + 1


class Words:
    """The words of some whole texts. hashes[which]: one a word; doc: index of a word's text; at: its place in the text."""

    def __init__(self, counts: np.ndarray, hashes: list[np.ndarray]):
        self.counts, self.hashes = counts, hashes
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.at = np.arange(self.first[-1]) - self.first[self.doc]

    def windows(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of each window of k words of one text."""
        n = len(self.doc)
        start = np.nonzero(self.doc[k - 1 :] == self.doc[: n - k + 1])[0] if n >= k else np.zeros(0, np.int64)
        return start, spans_hash(self.hashes[which], start, start + k, which)


def _hashed(texts: list[bytes], lower: bool, hashes: int) -> Words:
    """Words of texts of any length, hashed in blocks cut at separators."""
    counts, parts = np.zeros(len(texts), np.int64), []
    group: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if not group:
            return
        data = np.frombuffer(b"".join(t for _, t in group), np.uint8)
        data = _LOWER[data] if lower else data
        bounds = np.concatenate([[0], np.cumsum([len(t) for _, t in group])])
        starts, ends = word_places(data, bounds)
        parts.append([spans_hash(_BYTES[w][data], starts, ends, w) for w in range(hashes)])
        np.add.at(counts, np.array([i for i, _ in group])[np.searchsorted(bounds, starts, "right") - 1], 1)
        group, held = [], 0

    for i, text in enumerate(texts):
        while len(text) > BLOCK:
            cut = max(text.rfind(bytes([s]), 0, BLOCK) for s in np.nonzero(_SEP)[0])
            if cut <= 0:
                nxt = [p for s in np.nonzero(_SEP)[0] if (p := text.find(bytes([s]), BLOCK)) >= 0]
                cut = min(nxt, default=len(text))  # one word longer than a block
            flush()
            group.append((i, text[:cut]))
            flush()
            text = text[cut:]
        if held + len(text) > BLOCK:
            flush()
        group.append((i, text))
        held += len(text)
    flush()
    return Words(counts, [np.concatenate([p[w] for p in parts]) if parts else np.zeros(0, np.uint64) for w in range(hashes)])


def blocks(pairs: Iterable[tuple], lower: bool = False, hashes: int = 1, size: int = GROUP) -> Iterator[tuple[list, list[bytes], Words]]:
    """Groups of about `size` bytes of texts with their ids and words, from (id, text); a longer text is a group of its own."""
    some_ids, some, held = [], [], 0
    for i, t in pairs:
        if some and held + len(t) > size:
            yield some_ids, some, _hashed(some, lower, hashes)
            some_ids, some, held = [], [], 0
        some_ids.append(i)
        some.append(t)
        held += len(t)
    if some:
        yield some_ids, some, _hashed(some, lower, hashes)


def arrow_rows(batches: Iterator[pa.RecordBatch], some: int = 128) -> Iterator[tuple]:
    """Rows of the batches as tuples, of which `some` are made at a time; ask for texts as binary columns, so no Python string is
    made of them."""
    for b in batches:
        for i in range(0, b.num_rows, some):
            yield from zip(*[c.to_pylist() for c in b.slice(i, some).columns])
