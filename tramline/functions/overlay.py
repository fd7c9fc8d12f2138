"""Union of the rings of a footprint, exactly: a small helper for one building at a time."""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import combinations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers where they can be, which are far faster than fractions.
Number = int | Fraction
Point = tuple[Number, Number]
#: Scales up to which coordinates are made whole numbers, and beyond which they stay fractions.
MAX_SCALE = 1 << 200
POLYGONS = "array<array<array<struct<x:double,y:double>>>>"


def _over(a: Number, b: Number) -> Number:
    """a / b, exactly."""
    if isinstance(a, int) and isinstance(b, int):
        whole, rest = divmod(a, b)
        return Fraction(a, b) if rest else whole
    return a / b


def _scaled(rings: list[list[tuple[float, float]]]) -> tuple[list[list[Point]], int]:
    """The rings' coordinates times a scale, which makes them even numbers, and the scale."""
    exact = [[(Fraction(x), Fraction(y)) for x, y in r] for r in rings]
    scale = 2 * math.lcm(*(c.denominator for r in exact for p in r for c in p))
    if scale > MAX_SCALE:
        return exact, 1
    return [[(int(x * scale), int(y * scale)) for x, y in r] for r in exact], scale


def _cross(o: Point, a: Point, b: Point) -> Number:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _on(p: Point, a: Point, b: Point) -> bool:
    """Whether p, on the line through a and b, lies between them."""
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _meetings(a: Point, b: Point, c: Point, d: Point) -> list[Point]:
    """Where segments ab and cd meet: a point, or the ends of a common piece."""
    if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
        return []
    of_c, of_d, of_a, of_b = _cross(a, b, c), _cross(a, b, d), _cross(c, d, a), _cross(c, d, b)
    ends = [p for p, s, q, r in ((c, of_c, a, b), (d, of_d, a, b), (a, of_a, c, d), (b, of_b, c, d)) if s == 0 and _on(p, q, r)]
    if ends or (of_c > 0) == (of_d > 0) or (of_a > 0) == (of_b > 0) or 0 in (of_a, of_b, of_c, of_d):
        return ends
    return [(a[0] + _over(of_a * (b[0] - a[0]), of_a - of_b), a[1] + _over(of_a * (b[1] - a[1]), of_a - of_b))]


def _sides(m: Point, upright: bool, rings: list[list[tuple[Point, Point]]]) -> tuple[bool, bool]:
    """Whether it is inside any ring just beyond m (above, or right of an upright edge), and just before it. A ray from m counts
    the edges of a ring that it crosses; those that m lies on are between the two sides."""
    u, v = (1, 0) if upright else (0, 1)
    beyond = before = False
    for edges in rings:
        past = on = 0
        for a, b in edges:
            if (a[u] <= m[u]) != (b[u] <= m[u]):
                above = (m[u] - a[u]) * (b[v] - a[v]) - (m[v] - a[v]) * (b[u] - a[u])
                past += above > 0 if b[u] > a[u] else above < 0
                on += above == 0
        beyond |= past % 2 == 1
        before |= (past + on) % 2 == 1
    return beyond, before


def _twice_area(ring: list[Point]) -> Number:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))


def _middle(a: Point, b: Point) -> Point:
    return _over(a[0] + b[0], 2), _over(a[1] + b[1], 2)


def _walked(edges: list[tuple[Point, Point]]) -> list[list[Point]]:
    """Rings of directed edges with the area to their left, turning left as far as they can, so rings that touch stay apart."""
    out: dict[Point, list[Point]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    rings = []
    for start in sorted(out):
        while out[start]:
            ring, a, b = [start], start, out[start].pop(0)
            while b != start:
                ring.append(b)
                back = math.atan2(a[1] - b[1], a[0] - b[0])
                clockwise = lambda c: (back - math.atan2(c[1] - b[1], c[0] - b[0])) % (2 * math.pi) or 2 * math.pi  # noqa: B023, E731
                after = min(out[b], key=clockwise)
                out[b].remove(after)
                a, b = b, after
            rings.append([p for q, p, r in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1]) if _cross(q, p, r) != 0])
    return rings


def _meet_only_at_corners(edges: list[tuple[Point, Point]]) -> bool:
    """Whether the edges of one ring meet only where one follows the other."""
    n = len(edges)
    for i, j in combinations(range(n), 2):
        met = _meetings(*edges[i], *edges[j])
        follows = j == i + 1 or (i == 0 and j == n - 1)
        if met and not (follows and set(met) == {edges[i][1] if j == i + 1 else edges[i][0]}):
            return False
    return True


def united(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Polygons (outline, then holes; not closed) of the area that lies in any of the rings, where a ring that crosses itself
    holds what it goes round an odd number of times. A single ring that does not cross itself stays as it is.

    Edges are cut where they meet; those with the area on one side only are its boundary, which is then walked along. All is
    done in whole numbers or fractions, so nothing depends on rounding but the result."""
    exact, scale = _scaled(rings)
    plain = lambda r: [(float(Fraction(x, scale)), float(Fraction(y, scale))) for x, y in r]
    exact = [[p for p, q in zip(r, r[1:] + r[:1]) if p != q] for r in exact]
    exact = [r for r in exact if len(set(r)) >= 3]
    edges = [list(zip(r, r[1:] + r[:1])) for r in exact]
    if len(exact) == 1 and _meet_only_at_corners(edges[0]):
        return [[plain(exact[0])]] if _twice_area(exact[0]) else []
    every = [e for es in edges for e in es]
    cuts: list[set[Point]] = [set(e) for e in every]
    for i, j in combinations(range(len(every)), 2):
        for p in _meetings(*every[i], *every[j]):
            cuts[i].add(p)
            cuts[j].add(p)
    pieces = {pair for points in cuts for pair in zip(sorted(points), sorted(points)[1:])}
    kept = []
    for a, b in sorted(pieces):
        upright = a[0] == b[0]
        beyond, before = _sides(_middle(a, b), upright, edges)
        if beyond != before:
            # a is left of or below b, so the left side is above, or, of an upright edge, before.
            kept.append((a, b) if (before if upright else beyond) else (b, a))
    walked = [r for r in _walked(kept) if r]
    shells = sorted((r for r in walked if _twice_area(r) > 0), key=_twice_area)
    polygons = [[s] for s in shells]
    for hole in (r for r in walked if _twice_area(r) < 0):
        m = _middle(hole[0], hole[1])
        for polygon in polygons:
            if any(_sides(m, hole[0][0] == hole[1][0], [list(zip(polygon[0], polygon[0][1:] + polygon[0][:1]))])):
                polygon.append(hole)
                break
    return [[plain(r) for r in p] for p in polygons]


def _united(rings: pd.Series) -> pd.Series:
    plain = lambda rs: [[(p["x"], p["y"]) for p in r] for r in rs]
    return rings.map(lambda rs: None if rs is None else [[[{"x": x, "y": y} for x, y in r] for r in p] for p in united(plain(rs))])


def united_rings(rings: Column) -> Column:
    """united() of array<array<struct<x, y, ...>>>, in Arrow batches."""
    return F.pandas_udf(_united, POLYGONS)(rings)
