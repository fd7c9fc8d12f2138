"""Distances and map projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: GRS80: half axis, flattening.
A, FLAT = 6_378_137.0, 1 / 298.257222101
ECC2 = FLAT * (2 - FLAT)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once; spelled out, these formulas would be copied many times over."""
    return F.element_at(F.transform(F.array(value), body), 1)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def short_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres for near points: 111 320 a degree, longitudes shrunk at the mean latitude."""
    dx = (lon2 - lon1) * 111_320.0 * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + F.pow((lat2 - lat1) * 111_320.0, 2))


def walk_seconds(metres: Column, speed: Column) -> Column:
    """Whole seconds, half to even, never below 0."""
    return F.greatest(F.lit(0), F.rint(metres / speed).cast("int"))


def _q(sin_lat):
    """Authalic q of a latitude's sine (number)."""
    e = math.sqrt(ECC2)
    return (1 - ECC2) * (sin_lat / (1 - ECC2 * sin_lat**2) - math.log((1 - e * sin_lat) / (1 + e * sin_lat)) / (2 * e))


def laea_to_wgs84(easting: Column, northing: Column) -> tuple[Column, Column]:
    """ETRS89 / LAEA Europe to latitude and longitude, by the inverse closed form with the authalic latitude's series."""
    lat0, lon0, e0, n0 = math.radians(52), math.radians(10), 4_321_000.0, 3_210_000.0
    qp = _q(1.0)
    rq = A * math.sqrt(qp / 2)
    b0 = math.asin(_q(math.sin(lat0)) / qp)
    d = A * math.cos(lat0) / math.sqrt(1 - ECC2 * math.sin(lat0) ** 2) / (rq * math.cos(b0))
    e2, e4, e6 = ECC2, ECC2**2, ECC2**3

    def placed(p: Column) -> Column:
        """p: x, y, rho and c of the point."""
        x, y, rho, c = p["x"], p["y"], p["rho"], p["c"]
        there = rho > 0
        beta = F.when(there, F.asin(F.cos(c) * math.sin(b0) + d * y * F.sin(c) * math.cos(b0) / rho)).otherwise(b0)
        lon = F.when(there, F.atan2(x * F.sin(c), d * rho * math.cos(b0) * F.cos(c) - d * d * y * math.sin(b0) * F.sin(c))).otherwise(0.0)
        lat = lambda b: b + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * b) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * b) + (761 * e6 / 45360) * F.sin(6 * b)
        return F.struct(F.degrees(_let(beta, lat)).alias("lat"), F.degrees(lon + lon0).alias("lon"))

    def polar(p: Column) -> Column:
        rho = F.sqrt(F.pow(p["x"] / d, 2) + F.pow(p["y"] * d, 2))
        return _let(rho, lambda r: F.struct(p["x"].alias("x"), p["y"].alias("y"), r.alias("rho"), (2 * F.asin(r / (2 * rq))).alias("c")))

    point = F.struct((easting - e0).alias("x"), (northing - n0).alias("y"))
    out = _let(_let(point, polar), placed)
    return out["lat"], out["lon"]


def utm32_to_wgs84(easting: Column, northing: Column) -> tuple[Column, Column]:
    """ETRS89 / UTM zone 32N to latitude and longitude, by the inverse Krueger series."""
    n = FLAT / (2 - FLAT)
    r = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)

    def conformal(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        for j, b in enumerate(beta, 1):
            xi, eta = xi - b * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"]), eta - b * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def placed(p: Column) -> Column:
        def lat(chi: Column) -> Column:
            out = chi
            for j, d in enumerate(delta, 1):
                out = out + d * F.sin(2 * j * chi)
            return out

        chi = F.asin(F.sin(p["xi"]) / F.cosh(p["eta"]))
        return F.struct(F.degrees(_let(chi, lat)).alias("lat"), (F.lit(9.0) + F.degrees(F.atan2(F.sinh(p["eta"]), F.cos(p["xi"])))).alias("lon"))

    point = F.struct((northing / r).alias("xi"), ((easting - 500_000.0) / r).alias("eta"))
    out = _let(_let(point, conformal), placed)
    return out["lat"], out["lon"]


def _edges(ring: Column) -> Column:
    """array<struct<x1, y1, x2, y2>> of a ring of points with x and y, closed or not."""
    n = F.size(ring)
    after = lambda i: F.get(ring, F.pmod(i + 1, n))
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), after(i)["x"].alias("x2"), after(i)["y"].alias("y2")))


def widest_section(rings: Column) -> Column:
    """struct<width, x, y>: the middle of the widest piece of a level line through an area, in it wherever it has any width;
    null without one. rings: array of array<struct<x, y, ...>>, outlines and holes alike, closed or not.

    The line lies halfway between the corners next above and below the middle of the area's height, so it meets no corner. Its crossings
    with all edges, in order, are the ends of the pieces inside, two by two."""

    def over(ys: Column) -> Column:
        low, high = F.array_min(ys), F.array_max(ys)
        return _let((low + high) / 2, lambda mid: _let((F.array_max(F.filter(ys, lambda y: y <= mid)) + F.array_min(F.filter(ys, lambda y: y > mid))) / 2, crossed))

    def crossed(level: Column) -> Column:
        hit = F.filter(F.flatten(F.transform(rings, _edges)), lambda e: (e["y1"] > level) != (e["y2"] > level))
        xs = F.array_sort(F.transform(hit, lambda e: e["x1"] + (level - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
        return _let(xs, lambda at: F.aggregate(pieces(at, level), none, lambda best, p: F.when(best["width"].isNull() | (p["width"] > best["width"]), p).otherwise(best)))

    def pieces(at: Column, level: Column) -> Column:
        ids = F.filter(F.sequence(F.lit(0), F.greatest(F.size(at) - 2, F.lit(0))), lambda i: (i % 2 == 0) & (i + 1 < F.size(at)))
        return F.transform(ids, lambda i: F.struct((F.get(at, i + 1) - F.get(at, i)).alias("width"), ((F.get(at, i) + F.get(at, i + 1)) / 2).alias("x"), level.alias("y")))

    none = F.lit(None).cast("struct<width:double,x:double,y:double>")
    return _let(F.transform(F.flatten(rings), lambda p: p["y"]), over)


def point_on_surface(polygons: Column) -> Column:
    """struct<width, x, y>: a point inside an area of one or more polygons (arrays of rings), that of the widest section of all;
    of equally wide ones the first."""
    found = F.transform(polygons, widest_section)
    return F.aggregate(found, F.lit(None).cast("struct<width:double,x:double,y:double>"), lambda best, p: F.when(best["width"].isNull() | (p["width"] > best["width"]), p).otherwise(best))
