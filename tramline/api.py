"""One object for a feed: status, routes for batches of requests, and the map layers."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import client, times
from .plans import access, graphs, itinerary, surfaces, timetable
from .plans.raptor import journeys, search
from .plans.search import edge_labels, hops
from .shared import cut
from .sources.sinks import Catalog


@dataclass(frozen=True)
class Options:
    """Limits and speeds of a search."""

    horizon: int = 14_400
    max_wait: int = 1_200
    max_rounds: int = 8
    max_transfers: int = 4
    penalty: int = 0
    access_metres: float = 500
    candidates: int = 6
    walk_metres: float = 500
    walk_speed: float = 0.7
    walk_neighbours: int = 10

    def __post_init__(self):
        if self.walk_speed <= 0 or self.max_wait <= 0 or self.horizon <= 0:
            raise ValueError("walk_speed, max_wait and horizon must be above 0")

    def merged(self, **given) -> Options:
        """These options with those given that are not None."""
        return replace(self, **{k: v for k, v in given.items() if v is not None})


class Engine:
    """feed: tables stops, trips, stop_times, transfers (and routes, shapes for the line map). Derived tables are kept in a
    catalogue by all options, if one is given."""

    def __init__(self, spark: SparkSession, feed: dict[str, DataFrame], feed_id: str, options: Options | None = None, catalog: Catalog | None = None):
        self.spark, self.feed, self.feed_id, self.options, self.catalog = spark, feed, feed_id, options or Options(), catalog
        self._tables: dict[tuple, dict[str, DataFrame]] = {}

    def with_options(self, **given) -> Engine:
        """This feed under these options where they are not None, as a request may give them. Tables are shared: those that need
        other walks are built once for each kind, and kept beside the others."""
        other = Engine(self.spark, self.feed, self.feed_id, self.options.merged(**given), self.catalog)
        other._tables = self._tables
        return other

    def status(self) -> dict[str, str]:
        return {"status": "ok", "feed": self.feed_id, "method": "raptor"}

    def _built(self) -> dict[str, DataFrame]:
        stops, o = self.feed["stops"], self.options
        valid = timetable.valid_trips(timetable.merged_stops(timetable.timed_stops(self.feed["stop_times"], stops)))
        coords = timetable.canonical_coordinates(stops).withColumnRenamed("canonical", "stop")
        moves = graphs.canonical_transfers(self.feed["transfers"], stops)
        walks = graphs.walk_edges(coords, o.walk_metres, o.walk_speed, o.walk_neighbours, moves)
        return {"valid": valid, "patterns": timetable.trip_patterns(valid, self.feed["trips"]), "paths": graphs.footpaths(moves, walks), "coords": coords}

    def preload(self, rebuild: bool = False) -> dict[str, DataFrame]:
        """The timetable's tables for these walks: built once, or read from the catalogue."""
        walks = {k: v for k, v in asdict(self.options).items() if k.startswith("walk_")}
        key = tuple(walks.values())
        if key not in self._tables or rebuild:
            keep = lambda name, df: self.catalog.get_or_build(name, self.feed_id, walks, lambda: df, rebuild) if self.catalog else cut(df, name)
            self._tables[key] = {name: keep(name, df) for name, df in self._built().items()}
        return self._tables[key]

    def _ends(self, requests: DataFrame, side: str) -> DataFrame:
        """Candidate stops of one end: by id, else the nearest ones to its coordinates, else by exact name. An id together
        with coordinates, or half of a pair of coordinates, is an error."""
        ident, name, lat, lon = (F.col(f"{side}_{c}") for c in ("id", "name", "lat", "lon"))
        wrong: Column = (ident.isNotNull() & lat.isNotNull()) | (lat.isNull() != lon.isNull())
        req = requests.select("query_id", F.when(wrong, F.raise_error(F.lit(f"{side}: give an id, a name or both coordinates")).cast("string")).otherwise(ident).alias("id"), name.alias("name"), lat.alias("lat1"), lon.alias("lon1"))
        o, stops, coords = self.options, self.feed["stops"], self.preload()["coords"]
        c = timetable.canonical_stops(stops)
        by_id = req.filter("id is not null").join(c, F.col("id") == c["stop_id"]).select("query_id", F.col("canonical").alias("stop"), F.lit(0).alias("seconds"))
        named = stops.select("stop_id", F.lower("stop_name").alias("_n")).join(c, "stop_id").select("_n", "canonical").distinct()
        by_name = req.filter("id is null and lat1 is null and name is not null").join(named, F.lower(F.trim("name")) == F.col("_n")).select("query_id", F.col("canonical").alias("stop"), F.lit(0).alias("seconds"))
        places = stops.join(c, "stop_id").select("stop_id", "canonical", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
        near = access.candidates(req.filter("id is null and lat1 is not null").select("query_id", F.col("lat1").alias("lat"), F.col("lon1").alias("lon")), places, o.candidates, o.access_metres, o.walk_speed)
        return by_id.unionByName(by_name).unionByName(near.select("query_id", "stop", "seconds"))

    def checked(self, requests: DataFrame) -> DataFrame:
        """query_id, status and error of each request: 400 with what is wrong in it, else 200. A request is a row; what is wrong in one
        does not concern the others."""
        bad = []
        for side in ("origin", "destination"):
            ident, name, lat, lon = (F.col(f"{side}_{c}") for c in ("id", "name", "lat", "lon"))
            bad.append(F.when(client.endpoint_mode(ident, lat, lon, name) == "error", F.lit(f"{side}: give an id, a name or both coordinates")))
        bad.append(F.when(times.time_to_seconds(F.col("depart")).isNull(), F.concat(F.lit("not a time: "), F.coalesce("depart", F.lit("null")))))
        error = F.coalesce(*bad)
        return requests.select("query_id", F.when(error.isNull(), 200).otherwise(400).alias("status"), error.alias("error"))

    def journeys(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Steps of all options, with the walks from and to coordinates, names, colours and lines, and the options. Requests that
        checked() finds wrong have none."""
        t, o = self.preload(), self.options
        requests = cut(requests.join(self.checked(requests).filter("status = 200").select("query_id"), "query_id", "left_semi"), "requests")
        depart = times.time_to_seconds(F.col("depart"))
        bad = F.raise_error(F.concat(F.lit("not a time: "), F.coalesce("depart", F.lit("null")))).cast("int")
        queries = requests.select("query_id", F.coalesce(depart, bad).alias("depart"))
        rounds = min(o.max_rounds, o.max_transfers + 1)
        found = search(queries, self._ends(requests, "origin"), self._ends(requests, "destination"), t["valid"], t["patterns"], t["paths"], rounds, o.horizon, o.max_wait, o.penalty)
        steps = itinerary.stitched(journeys(found), found.options, found.starts, found.ends)
        steps = itinerary.described(steps, self.feed["trips"], self.feed["routes"], self.feed["stops"])
        if "shapes" in self.feed:
            steps = itinerary.with_geometry(steps, self.feed["shapes"], t["coords"])
        return cut(steps, "route-steps"), cut(found.options, "route-options")

    def route(self, requests: DataFrame) -> DataFrame:
        """requests(query_id, depart (H:MM:SS), origin_id, origin_name, origin_lat, origin_lon, destination_...) -> one row for each
        option, as itinerary.answers() has them, with arrival_time and status 200. A request without an option is one row
        of nulls with its status and error: 400 and what checked() finds wrong, 404 if a name, id or place leads to no stop or
        no way is found."""
        steps, options = self.journeys(requests)
        found = itinerary.answers(steps, options, self.options.penalty).withColumn("arrival_time", times.seconds_to_time(F.col("arrival")))
        said = self.checked(requests).withColumnRenamed("status", "_status")
        got = F.col("place").isNotNull()
        return said.join(found, "query_id", "left").select("query_id", F.when(got, 200).when(F.col("_status") == 200, 404).otherwise(F.col("_status")).alias("status"), F.coalesce("error", F.when(~got, F.lit("no way was found"))).alias("error"), *[c for c in found.columns if c != "query_id"])

    def search_graph(self, requests: DataFrame, method: str = "trip_stop_anytime", state_by: str = "route", change_penalty: int = 0) -> DataFrame:
        """Hops to each request's destination by a search over edges, as search.hops() has them: over rides without clock times
        (trip_stop_anytime) or with them (multi_edge). Ends are the first candidates of each side. Wrong requests have no hops."""
        if method not in ("trip_stop_anytime", "multi_edge"):
            raise ValueError("method is trip_stop_anytime or multi_edge")
        t, o, trips = self.preload(), self.options, self.feed["trips"]
        requests = cut(requests.join(self.checked(requests).filter("status = 200").select("query_id"), "query_id", "left_semi"), "requests")
        timed = timetable.timed_stops(self.feed["stop_times"], self.feed["stops"])
        pairs = timetable.consecutive(timed)
        rides = pairs.filter("weight is not null").drop("weight").withColumn("weight", F.lit(None).cast("int"))
        if method == "trip_stop_anytime":
            rides = graphs.anytime_edges(pairs, trips, timetable.segment_medians(pairs, trips), timetable.headways(timed, trips))
        walks = t["paths"].filter("is_walk")
        moves = t["paths"].filter("not is_walk").withColumnRenamed("seconds", "weight")
        edges = cut(graphs.search_edges(rides, trips, moves, walks), "edges")
        first = lambda side: self._ends(requests, side).groupBy("query_id").agg(F.min(F.struct("seconds", "stop")).alias("e")).select("query_id", "e.stop", "e.seconds")
        start = first("origin").join(requests.select("query_id", times.time_to_seconds(F.col("depart")).alias("depart")), "query_id")
        start = cut(start.select("query_id", "stop", (F.col("depart") + F.col("seconds")).cast("int").alias("depart")), "starts")
        goals = cut(first("destination").select("query_id", "stop"), "goals")
        return hops(edge_labels(start, edges, goals, t["coords"], o.horizon, o.max_wait, o.penalty, change_penalty, state_by), goals)

    def map_layers(self, requests: DataFrame) -> DataFrame:
        """GeoJSON features of each option: query_id, round, pos, layer (ride, walk, transfer or stop), colour, feature."""
        steps, _ = self.journeys(requests)
        mode = F.when(F.col("kind") == "trip", "ride").when(F.col("label") == "walk", "walk").otherwise("transfer")
        line = F.when(F.col("line_string").isNotNull(), F.to_json(F.struct(F.lit("LineString").alias("type"), F.col("line_string").alias("coordinates"))))
        rows = steps.select("query_id", "round", "pos", mode.alias("layer"), "colour", line.alias("feature"))
        ends = F.explode(F.array(F.get("line_string", F.lit(0)), F.element_at("line_string", -1)))
        stops = steps.filter("line_string is not null and kind = 'trip'").select("query_id", "round", "pos", ends.alias("p"))
        point = F.to_json(F.struct(F.lit("Point").alias("type"), F.col("p").alias("coordinates")))
        return rows.filter("feature is not null").unionByName(stops.select("query_id", "round", "pos", F.lit("stop").alias("layer"), F.lit(None).cast("string").alias("colour"), point.alias("feature")).distinct())

    def network_lines(self, rapid_only: bool = False) -> DataFrame:
        lines = surfaces.network_lines(self.feed["routes"], self.feed["trips"], self.feed["shapes"])
        return lines.filter(F.col("family").isin("u_bahn", "s_bahn")) if rapid_only else lines


def population_grid(cells: DataFrame, year: int, bounds: tuple[float, float, float, float] | None = None, merged: bool = False) -> DataFrame:
    """GeoJSON polygons of a census year's cells; merged: one of each grid_id, with n, the number of its rows."""
    rows = surfaces.population_cells(cells, year, bounds, merged)
    return rows.select("grid_id", "estimate", *(["n"] if merged else []), F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates"))).alias("geometry"))


def floor_space_density(grid: DataFrame, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """GeoJSON points of floor-space cells within bounds (min_lat, min_lon, max_lat, max_lon)."""
    rows = grid.dropna(subset=["lat", "lon", "floor_space", "density", "people", "people_density"])
    if bounds:
        rows = rows.filter(F.col("lat").between(bounds[0], bounds[2]) & F.col("lon").between(bounds[1], bounds[3]))
    return rows.select("n", "floor_space", "density", "people", "people_density", F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))).alias("geometry"))
