"""Plain Python versions of the operators, straight from their contracts."""

from __future__ import annotations

import hashlib
import re

SECRETS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16),
]


def luhn(m):
    d = re.sub("[^0-9]", "", m[0])
    return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
]


def spans(text, kinds):
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    return [x[2] for x in sorted(found)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def statistics(text):
    ws = words(text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(ws) - 4):
        windows.setdefault(tuple(ws[i : i + 5]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def deduplicated(docs, window=20):
    """(id, text) -> {id: (n_words, n_removed, kept)}; ids are different and not null."""
    seen, rep = set(), {}
    for i, text in sorted(docs):
        ws, rep[i] = words(text), set()
        for s in range(len(ws) - window + 1):
            key = tuple(ws[s : s + window])
            if key in seen:
                rep[i].update(range(s, s + window))
            seen.add(key)
    return {i: (len(ws := words(t)), len(rep[i]), " ".join(w for p, w in enumerate(ws) if p not in rep[i])) for i, t in docs}


def groups(docs, k=4, percent=85):
    """(id, text) -> {id: (n_shingles, component)}."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in docs:
        ws = words((text or "").translate(lower))
        sets[i] = {tuple(ws[p : p + k]) for p in range(len(ws) - k + 1)} or ({tuple(ws)} if ws else set())
    comp = {i: i for i in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                comp[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def least_determinant(x, floors, half, inflate, inflate_last, reach, still=1e-4, steps=12):
    """Squared distances under the reweighted minimum covariance determinant fit of x, by numpy."""
    import numpy as np

    x, floor = np.asarray(x, float), np.diag(np.square(floors))
    ranked = lambda v, p: np.sort(v, axis=0)[int(np.ceil(p * len(v))) - 1]
    square = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    fit = lambda rows, by: (rows.mean(axis=0), by * np.cov(rows.T, bias=True) + floor)
    mid = ranked(x, 0.5)
    wide = np.square(1.4826 * ranked(np.abs(x - mid), 0.5)) + np.diag(floor)
    fits = [(mid, np.diag(wide)), fit(x, 1.0), fit(x[(np.abs(x - mid) <= 2.5 * np.sqrt(wide)).all(axis=1)], 1.0)]
    for _ in range(steps):
        new = [fit(x[(d := square(m, c)) <= ranked(d, half)], inflate) for m, c in fits]
        moved = any(abs(np.linalg.slogdet(a[1])[1] - np.linalg.slogdet(b[1])[1]) > still for a, b in zip(fits, new))
        fits = new
        if not moved:
            break
    m, c = min(fits, key=lambda f: np.linalg.slogdet(f[1])[1])
    return square(*fit(x[square(m, c) <= reach], inflate_last))


_MARKS = r"\"':=,;|(){}<>\[\]"
_PIECE = re.compile(f"[^\x20\x09-\x0d{_MARKS}]*[{_MARKS}]+|[^\x20\x09-\x0d{_MARKS}]+")
_RUN = re.compile("[A-Za-z0-9@_#./+-]+")


def tokens(text):
    """Identifier-like (start, end)."""
    for m in _RUN.finditer(text):
        own = re.sub("[^A-Za-z0-9]+$", "", m[0])
        if len(own) >= 5 and len(re.findall("[0-9]", own)) >= 3 and own[0] not in "./-":
            yield m.start(), m.start() + len(own)


def patterns(text, start, end):
    norm = lambda w: re.sub("[0-9]", "9", w.lower())
    out, before, after = [], text[:start], text[end:]
    if re.search(f"[\x20\x09-\x0d{_MARKS}]$", before):
        ws = [norm(w) for w in _PIECE.findall(before)]
        out += [f"2 {' '.join(ws[-2:])}"] * (len(ws) >= 2) + [f"1 {ws[-1]}"] if ws else []
    m = re.match(f"[{_MARKS}]*[\x20\x09-\x0d]+({_PIECE.pattern})", after)
    return out + ([f"n {norm(m[1])}"] if m else [])


def found(texts, rounds=3, min_support=5, min_precision=0.5, min_score=0.8):
    """[(start, end) of the spans that bootstrapping adds] of each text."""
    places, totals, edges = [], {}, {}
    for t in texts:
        t = t or ""
        base = [(int(a), int(b), True) for _, a, b in (x.split(":") for x in spans(t, PERSONAL))]
        more = [(a, b, False) for a, b in tokens(t) if not any(x < b and a < y for x, y, _ in base)]
        places.append([(a, b, seed, t[a:b], patterns(t, a, b)) for a, b, seed in base + more])
        ws = _PIECE.findall(re.sub("[0-9]", "9", t.lower()))
        for p in [f"2 {a} {b}" for a, b in zip(ws[:-2], ws[1:-1])] + [f"1 {w}" for w in ws[:-1]] + [f"n {w}" for w in ws[1:]]:
            totals[p] = totals.get(p, 0) + 1
        for _, _, seed, inst, pats in places[-1]:
            for p in pats:
                edges[p, inst, seed] = edges.get((p, inst, seed), 0) + 1
    by: dict[str, list] = {}
    for (p, inst, seed), n in edges.items():
        by.setdefault(p, []).append((inst, seed, n))
    by = {p: e for p, e in by.items() if len({i for i, _, _ in e}) >= min_support and not all(s for _, s, _ in e) and sum(n for _, _, n in e) >= min_precision * totals.get(p, 0) > 0}
    known = {i for e in by.values() for i, s, _ in e if s}
    score: dict[str, float] = {}
    for _ in range(rounds):
        score = {}
        for p, e in by.items():
            good = [(i, n) for i, s, n in e if s or i in known]
            if len({i for i, _ in good}) >= min_support and (x := sum(n for _, n in good) / totals[p]) >= min_precision:
                score[p] = min(x, 0.999)
        miss: dict[str, float] = {}
        for p, x in score.items():
            for i, _, _ in by[p]:
                miss[i] = miss.get(i, 1.0) * (1 - x) ** sum(j == i for j, _, _ in by[p])
        # A pattern's edge counts once for an instance that is seed and token alike only if it is both.
        known |= {i for i, m in miss.items() if 1 - m >= min_score}
    return [sorted({(a, b) for a, b, seed, i, pats in row if not seed and i in known and any(p in score and (i, False) in {(x, s) for x, s, _ in by[p]} for p in pats)}) for row in places]
