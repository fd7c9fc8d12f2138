"""Line names, families and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: line names, colours, offsets and palettes of the network map.
AIRPORT_LINES = ("A1", "A2", "A3", "A11")
FAMILY_RANK = {"u_bahn": 0, "s_bahn": 1, "a_line": 2, "regional": 3}
LINE_COLOURS = {"U1": "#005AAE", "U2": "#D62828", "U3": "#F2C300", "U4": "#0F8B8D", "S1": "#2E9E45", "S2": "#7E57C2", "S3": "#F28E2B", "S5": "#E754A6", "A1": "#B7E000", "A2": "#D8C6A5", "A3": "#800020", "A11": "#8B4513"}
REGIONAL_COLOUR = "#000000"
PALETTES = {
    "u_bahn": ("#005AAE", "#0A72C7", "#0080C8", "#276FBF", "#2B6CB0"),
    "s_bahn": ("#007A3D", "#0C8A49", "#1F9D5A", "#2FA84F", "#4BAE4F"),
    "regional": ("#C33C54", "#D1495B", "#E76F51", "#CF5C36", "#A93F55"),
    "a_line": ("#B7E000", "#D8C6A5", "#800020", "#8B4513"),
}
LINE_OFFSETS = {"U1": -3.0, "U2": -1.0, "U3": 1.0, "U4": 3.0, "S1": -3.0, "S2": -1.0, "S3": 1.0, "S5": 3.0, "A1": -3.0, "A2": -1.0, "A3": 1.0, "A11": 3.0}
OFFSETS = (-4.0, -2.0, 0.0, 2.0, 4.0)
MAX_GAP_M = 900.0


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _spare(line: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (stable_hash(line) % len(values) + 1).cast("int"))


def family(name: Column) -> Column:
    """u_bahn, s_bahn, regional, a_line or null; replacement buses (SEV) have none."""
    n = F.upper(F.trim(name))
    return (
        F.when(n.contains("SEV"), None)
        .when(n.startswith("U"), "u_bahn")
        .when(n.startswith("S"), "s_bahn")
        .when(n.startswith("RE") | n.startswith("RB"), "regional")
        .when(n.isin(*AIRPORT_LINES), "a_line")
    )


def rapid(name: Column, shape: Column) -> Column:
    """Whether a route's name and shape put it on the network map."""
    n = F.upper(name)
    some = n.startswith("U") | n.startswith("S") | n.startswith("RE") | n.startswith("RB") | n.isin(*AIRPORT_LINES)
    return some & ~n.contains("SEV") & shape.isNotNull()


def hex_colour(c: Column) -> Column:
    """#RRGGBB in upper case from six hex digits with or without leading hash marks, else null."""
    bare = F.regexp_replace(F.trim(c), "^#+", "")
    return F.when(bare.rlike("^[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), F.upper(bare)))


def stable_hash(c: Column) -> Column:
    """h * 31 + code of each character in turn, within 32 bits."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: F.pmod(h * 31 + x, F.lit(1 << 32)))


def line_colour(line: Column, fam: Column, own: Column) -> Column:
    """Fixed colour, else black for regional lines, else the feed's own, else one of the family's palette by the name's hash."""
    chosen = F.coalesce(*[F.when(fam == f, _spare(line, p)) for f, p in PALETTES.items()])
    return F.coalesce(F.try_element_at(_map(LINE_COLOURS), line), F.when(fam == "regional", REGIONAL_COLOUR), own, chosen)


def line_offset(line: Column, fam: Column) -> Column:
    """Fixed offset, else 0 for regional lines, else one of the palette by the name's hash."""
    return F.coalesce(F.try_element_at(_map(LINE_OFFSETS), line), F.when(fam == "regional", 0.0), _spare(line, OFFSETS))


def family_rank(fam: Column) -> Column:
    return F.try_element_at(_map(FAMILY_RANK), fam)
