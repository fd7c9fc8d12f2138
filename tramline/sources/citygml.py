"""LoD1 buildings of CityGML files, by Spark's XML reader."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import point_on_surface
from ..functions.overlay import united_rings
from ..functions.times import blank_to_null
from ..shared import importable
from .gtfs import listed

RELEASE = r"LoD1-DE_HH_(\d{4}-\d{2}-\d{2})"
#: Height difference up to which a face is level or two faces are at one level.
LEVEL = 0.01
SCHEMA = """`_gml:id` string, `gml:name` string, `bldg:function` string, `bldg:roofType` string, `bldg:measuredHeight` struct<_VALUE: double>, `bldg:storeysAboveGround` int,
 `bldg:lod1Solid` struct<`gml:Solid`: struct<`gml:exterior`: struct<`gml:CompositeSurface`: struct<`gml:surfaceMember`: array<struct<`gml:Polygon`: struct<`gml:exterior`: struct<`gml:LinearRing`: struct<`gml:posList`: string>>>>>>>>>,
 `bldg:lod1TerrainIntersection` struct<`gml:MultiCurve`: struct<`gml:curveMember`: array<struct<`gml:LineString`: struct<`gml:posList`: string>>>>>,
 `bldg:address` struct<`core:Address`: struct<`core:xalAddress`: struct<`xAL:AddressDetails`: struct<`xAL:Country`: struct<`xAL:CountryName`: string, `xAL:Locality`: struct<`xAL:LocalityName`: string, `xAL:Thoroughfare`: struct<`xAL:ThoroughfareName`: string, `xAL:ThoroughfareNumber`: string>, `xAL:PostalCode`: struct<`xAL:PostalCodeNumber`: string>>>>>>>,
 `gen:stringAttribute` array<struct<_name: string, `gen:value`: string>>"""


def points(pos_list: Column) -> Column:
    """array<struct<x, y, z>> of a posList; an error if its numbers are not threes."""
    numbers = F.transform(F.filter(F.split(F.trim(pos_list), r"\s+"), lambda t: t != ""), lambda t: t.cast("double"))
    whole = F.when(F.size(numbers) % 3 == 0, numbers).otherwise(F.raise_error(F.lit("posList is not made of threes")).cast("array<double>"))
    ids = F.when(F.size(whole) >= 3, F.sequence(F.lit(0), F.floor(F.size(whole) / 3).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(ids, lambda i: F.struct(F.get(whole, i * 3).alias("x"), F.get(whole, i * 3 + 1).alias("y"), F.get(whole, i * 3 + 2).alias("z")))


def ring_area(ring: Column) -> Column:
    """Area of a ring of points by the shoelace sum, whether it is closed or not."""
    cross = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % F.size(ring))["y"] - F.get(ring, (i + 1) % F.size(ring))["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def polygons_area(polygons: Column) -> Column:
    """Area of polygons (outline, then holes)."""
    own = lambda p: F.aggregate(F.transform(p, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.transform(polygons, own), F.lit(0.0), lambda a, x: a + x)


def polygons_wkt(polygons: Column) -> Column:
    """MULTIPOLYGON of polygons (outline, then holes)."""
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(F.concat(r, F.slice(r, 1, 1)), point), ", "), F.lit(")"))
    one = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    return F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(polygons, one), ", "), F.lit(")"))


def release_folder(spark: SparkSession, root: str) -> str:
    """The only folder below root that is named as a release; an error if there is none or more."""
    found = [p for n, p, is_file in listed(spark, root) if not is_file and re.fullmatch(RELEASE, n)]
    if len(found) != 1:
        raise ValueError(f"{'several releases' if found else 'no release'} in {root}: {', '.join(found)}")
    return found[0]


def read_release(spark: SparkSession, root: str) -> DataFrame:
    """read_buildings() of all .xml files of root's one release."""
    return read_buildings(spark, f"{release_folder(spark, root)}/*.xml")


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    """building_id, release, function, height, storeys, ground, roof, area, footprint (WKT), x, y (a point of it), country,
    locality, street_name, street_number, postal_code, attributes of each building.

    The footprint is the terrain intersection's closed lines, else the solid's lowest level faces; ground is the footprint's
    least height, roof the solid's greatest one, else ground and height. A building without an id or a footprint is an error.
    A footprint's rings are united, and one that crosses itself is repaired (see overlay.united()); rings of fewer than three
    corners or no area are left out. x and y are the middle of the footprint's widest section, so they lie in it. Blank
    address fields are null."""
    importable(spark)
    rows = spark.read.option("rowTag", "bldg:Building").schema(SCHEMA).xml(path).withColumn("_file", F.input_file_name())
    members = F.col("`bldg:lod1Solid`.`gml:Solid`.`gml:exterior`.`gml:CompositeSurface`.`gml:surfaceMember`")
    faces = F.transform(members, lambda m: points(m["gml:Polygon"]["gml:exterior"]["gml:LinearRing"]["gml:posList"]))
    rows = rows.withColumn("_faces", faces)
    z = lambda f: F.transform(f, lambda p: p["z"])
    level = F.filter("_faces", lambda f: F.array_max(z(f)) - F.array_min(z(f)) <= LEVEL)
    rows = rows.withColumn("_level", level).withColumn("_low", F.array_min(F.transform("_level", lambda f: F.array_min(z(f)))))
    base = F.filter("_level", lambda f: (F.array_min(z(f)) - F.col("_low") <= LEVEL) & (ring_area(f) > 0))
    lines = F.transform("`bldg:lod1TerrainIntersection`.`gml:MultiCurve`.`gml:curveMember`", lambda m: points(m["gml:LineString"]["gml:posList"]))
    rings = F.filter(F.coalesce(lines, F.array().cast("array<array<struct<x:double,y:double,z:double>>>")), lambda r: (F.size(F.array_distinct(F.transform(r, lambda p: F.struct(p["x"], p["y"])))) >= 3))
    rows = rows.withColumn("_terrain", rings).withColumn("_base", F.when(F.size("_terrain") > 0, F.col("_terrain")).otherwise(base))
    rows = rows.withColumn("ground", F.array_min(F.transform("_base", lambda f: F.array_min(z(f)))))
    ok = F.col("`_gml:id`").isNotNull() & (F.size("_base") > 0)
    ident = F.when(ok, F.col("`_gml:id`")).otherwise(F.raise_error(F.concat(F.lit("building without id or footprint: "), F.coalesce("`_gml:id`", F.lit("?")))))
    height = F.col("`bldg:measuredHeight`._VALUE")
    top = F.array_max(F.transform("_faces", lambda f: F.array_max(z(f))))
    named = F.filter(F.coalesce(F.col("`gen:stringAttribute`"), F.array().cast("array<struct<_name:string,`gen:value`:string>>")), lambda a: F.trim(a["_name"]) != "")
    attributes = F.map_from_entries(F.transform(named, lambda a: F.struct(a["_name"].alias("k"), a["gen:value"].alias("v"))))
    country = F.col("`bldg:address`.`core:Address`.`core:xalAddress`.`xAL:AddressDetails`.`xAL:Country`")
    place = country["xAL:Locality"]
    said = {"country": country["xAL:CountryName"], "locality": place["xAL:LocalityName"], "street_name": place["xAL:Thoroughfare"]["xAL:ThoroughfareName"], "street_number": place["xAL:Thoroughfare"]["xAL:ThoroughfareNumber"], "postal_code": place["xAL:PostalCode"]["xAL:PostalCodeNumber"]}
    address = [blank_to_null(v).alias(k) for k, v in said.items()]
    rows = rows.withColumn("_area", united_rings(F.col("_base")))
    rows = rows.withColumn("_point", point_on_surface(F.col("_area")))
    return rows.select(ident.alias("building_id"), F.regexp_extract("_file", RELEASE, 0).alias("release"), F.col("`bldg:function`").alias("function"), height.alias("height"), F.col("`bldg:storeysAboveGround`").alias("storeys"), "ground", F.coalesce(top, F.col("ground") + height).alias("roof"), polygons_area(F.col("_area")).alias("area"), polygons_wkt(F.col("_area")).alias("footprint"), F.col("_point.x").alias("x"), F.col("_point.y").alias("y"), *address, attributes.alias("attributes"))
