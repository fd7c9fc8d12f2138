"""What a client or a request makes of single values: endpoint modes, labels, map shapes, edge times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import blank_to_null, time_to_seconds

METRES_A_DEGREE = 111_320.0


def endpoint_mode(ident: Column, lat: Column, lon: Column, name: Column) -> Column:
    """id, coords or name, in that order; "error" for an id with coordinates, half of a pair, or nothing at all."""
    half = lat.isNull() != lon.isNull()
    return F.when((ident.isNotNull() & (lat.isNotNull() | lon.isNotNull())) | half, "error").when(ident.isNotNull(), "id").when(lat.isNotNull(), "coords").when(name.isNotNull(), "name").otherwise("error")


def coordinate_label(lat: Column, lon: Column) -> Column:
    return F.format_string("%.6f, %.6f", lat, lon)


def valid_point(lon: Column, lat: Column) -> Column:
    """Whether both are finite numbers."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return fine(lon) & fine(lat)


def cell_square(lat: Column, lon: Column, side: float) -> Column:
    """Closed ring of (lon, lat) of a square of `side` metres about a centre."""
    dy, dx = F.lit(side / 2 / METRES_A_DEGREE), F.lit(side / 2 / METRES_A_DEGREE) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))
    corner = lambda i, j: F.array(F.round(lon + i * dx, 6), F.round(lat + j * dy, 6))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


def ramp(value: Column, stops: list[tuple[float, float]]) -> Column:
    """Linear interpolation between (value, result) stops, flat beyond them; a missing value counts as -1."""
    x = F.coalesce(value.cast("double"), F.lit(-1.0))
    out = F.lit(float(stops[-1][1]))
    for (a, p), (b, q) in reversed(list(zip(stops, stops[1:]))):
        out = F.when(x < b, p + (q - p) * (x - a) / (b - a)).otherwise(out)
    return F.when(x <= stops[0][0], float(stops[0][1])).otherwise(out)


def chosen_option(asked: Column, n: Column, best: Column) -> Column:
    """The place asked for, or the best one's where that is out of range."""
    return F.when((asked >= 0) & (asked < n), asked).otherwise(best)


def scheduled_seconds(dep: Column, arr: Column, dep_text: Column, arr_text: Column) -> Column:
    """An edge's time: of its numbers, else of both its texts; null if neither has both or it arrives before it leaves."""
    d, a = F.coalesce(dep, time_to_seconds(dep_text)), F.coalesce(arr, time_to_seconds(arr_text))
    return F.when(a >= d, a - d)


def departure_cursor(now: Column, dep: Column, arr: Column, headway: Column, max_wait: Column, zero_missing: bool = False) -> Column:
    """When a ride is left with: its departure, if that is within the wait and it does not arrive before; half a headway from now
    for a ride without times; now, if missing times count as none; else null."""
    timed = dep.isNotNull() & arr.isNotNull()
    ok = (dep >= now) & (max_wait.isNull() | (dep - now <= max_wait)) & (arr >= dep)
    return F.when(timed, F.when(ok, dep)).when(headway.isNotNull(), now + F.floor(headway / 2).cast("int")).when(F.lit(zero_missing), now)


def ride_key(route: Column, trip: Column, by: str = "route") -> Column:
    """What two rides of one vehicle or line share."""
    return F.coalesce(route, trip) if by == "route" else F.coalesce(trip, route)


def terminal(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(f"{prefix}::"), name)


def leg_key(trip: Column, route: Column, label: Column, from_stop: Column, to_stop: Column) -> Column:
    return F.coalesce(trip, route, label, F.concat_ws("|", from_stop, to_stop))


def popup(density: Column, estimate: Column) -> Column:
    return F.concat(F.format_number(F.rint(density), 0), F.lit(" / "), F.format_number(F.rint(estimate), 0))


def duration_words(seconds: Column) -> Column:
    """A way's time as a client shows it: < 1 min, minutes, or hours and minutes."""
    minutes = F.rint(seconds / 60).cast("int")
    return F.when(seconds < 60, "< 1 min").when(seconds < 3600, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" hr "), (minutes % 60).cast("string"), F.lit(" min")))


def legend_position(value: Column, most: Column) -> Column:
    """Place of a value on a legend, in percent of the greatest one."""
    return F.when(most != 0, 100.0 * value / most)


def numeric(text: Column) -> Column:
    """Whether a text is a number, blanks around it aside."""
    return blank_to_null(text).try_cast("double").isNotNull()


def title(name: Column) -> Column:
    """A name in underscores as words with capitals."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def number_or_null(x: Column) -> Column:
    """x, but null where it is not a number."""
    return F.nanvl(x, F.lit(None).cast("double"))


def placed(value: Column, default: float) -> Column:
    """A coordinate, or the map's where it is unknown."""
    return F.coalesce(value, F.lit(default))
