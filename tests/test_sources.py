"""Files in, files out."""

import pytest
from pyspark.sql import functions as F

from tramline.sources import census, citygml, gtfs, sinks
from tramline.streaming.requests import answer_requests, hourly_counts


def test_gtfs_folder(spark, tmp_path):
    feed = tmp_path / "feed-a"
    feed.mkdir()
    for name in gtfs.REQUIRED:
        (feed / f"{name}.txt").write_text("x\n1\n")
    (feed / "stops.txt").write_text("stop_id,stop_name,stop_lat,extra\nS1,Main,53.5,u\nS2,Mainz,bad,v\n")
    (feed / "calendar.txt").write_text("service_id,start_date,monday\n1,20240102,1\n2,2024,x\n")
    tables = gtfs.read_feed(spark, str(feed))
    assert [tuple(r) for r in tables["stops"].orderBy("stop_id").collect()] == [("S1", "Main", 53.5, "u", "feed-a"), ("S2", "Mainz", None, "v", "feed-a")]
    assert [r.start_date is None for r in tables["calendar"].orderBy("service_id").collect()] == [False, True]
    assert gtfs.the_feed(tables["stops"]) == "feed-a"
    assert gtfs.find_stop(tables["stops"], " MAIN ") == "S1"
    with pytest.raises(ValueError, match="ambiguous"):
        gtfs.find_stop(tables["stops"], "ai")
    assert set(gtfs.read_feeds(spark, str(tmp_path))) == set(gtfs.REQUIRED)
    out = str(tmp_path / "tables")
    assert gtfs.ingest(spark, str(feed), out, dry_run=True)["stops"] == 2 and not (tmp_path / "tables").exists()
    for drop, n in ((False, 2), (False, 4), (True, 2)):
        assert gtfs.ingest(spark, str(feed), out, skip=("agency",), drop_existing=drop)["stops"] == 2
        assert spark.read.parquet(f"{out}/stops").count() == n
    assert gtfs.of_feed(tables["stops"], "feed-a").columns == ["stop_id", "stop_name", "stop_lat", "extra"] and gtfs.of_feed(tables["stops"], "b").isEmpty()
    (feed / "trips.txt").unlink()
    with pytest.raises(ValueError, match="trips"):
        gtfs.read_feed(spark, str(feed))


GML = """<?xml version="1.0"?><core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g" xmlns:gen="n"><core:cityObjectMember><bldg:Building gml:id="B1">
<gen:stringAttribute name="k"><gen:value>v</gen:value></gen:stringAttribute><bldg:measuredHeight uom="m">12.5</bldg:measuredHeight><bldg:storeysAboveGround>4</bldg:storeysAboveGround>
<bldg:lod1Solid><gml:Solid><gml:exterior><gml:CompositeSurface>{}</gml:CompositeSurface></gml:exterior></gml:Solid></bldg:lod1Solid></bldg:Building></core:cityObjectMember></core:CityModel>"""
FACE = "<gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>{}</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember>"


def test_citygml_building(spark, tmp_path):
    folder = tmp_path / "LoD1-DE_HH_2023-04-01"
    folder.mkdir()
    square = lambda z: " ".join(f"{x} {y} {z}" for x, y in ((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)))
    (folder / "t.xml").write_text(GML.format(FACE.format(square(4)) + FACE.format(square(16.5)) + FACE.format("0 0 4 10 0 4 10 0 16.5 0 0 4")))
    row = citygml.read_buildings(spark, str(folder / "t.xml")).first()
    assert (row.building_id, row.release, row.height, row.storeys, row.ground, row.roof, row.area) == ("B1", "LoD1-DE_HH_2023-04-01", 12.5, 4, 4.0, 16.5, 100.0)
    assert row.footprint.startswith("MULTIPOLYGON (((0.0 0.0, 10.0 0.0") and row.attributes == {"k": "v"}


def test_citygml_terrain_address_and_releases(spark, tmp_path):
    folder = tmp_path / "LoD1-DE_HH_2023-04-01"
    folder.mkdir()
    ring = lambda z, n: " ".join(f"{x} {y} {z}" for x, y in ((0, 0), (n, 0), (n, n), (0, n), (0, 0)))
    terrain = f"<bldg:lod1TerrainIntersection><gml:MultiCurve><gml:curveMember><gml:LineString><gml:posList>{ring(3, 20)}</gml:posList></gml:LineString></gml:curveMember></gml:MultiCurve></bldg:lod1TerrainIntersection>"
    where = '<bldg:address><core:Address><core:xalAddress><xAL:AddressDetails xmlns:xAL="x"><xAL:Country><xAL:CountryName>Land</xAL:CountryName><xAL:Locality><xAL:LocalityName>Ort</xAL:LocalityName><xAL:Thoroughfare><xAL:ThoroughfareNumber>7a</xAL:ThoroughfareNumber><xAL:ThoroughfareName> Weg </xAL:ThoroughfareName></xAL:Thoroughfare><xAL:PostalCode><xAL:PostalCodeNumber> </xAL:PostalCodeNumber></xAL:PostalCode></xAL:Locality></xAL:Country></xAL:AddressDetails></core:xalAddress></core:Address></bldg:address>'
    (folder / "t.xml").write_text(GML.format(FACE.format(ring(4, 10)) + FACE.format(ring(16.5, 10))).replace("<bldg:lod1Solid>", terrain + where + "<bldg:lod1Solid>"))
    row = citygml.read_release(spark, str(tmp_path)).first()
    assert (row.ground, row.roof, row.area, row.x, row.y) == (3.0, 16.5, 400.0, 10.0, 10.0)
    assert (row.country, row.locality, row.street_name, row.street_number, row.postal_code) == ("Land", "Ort", "Weg", "7a", None)
    (tmp_path / "LoD1-DE_HH_2024-04-01").mkdir()
    with pytest.raises(ValueError, match="several"):
        citygml.release_folder(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no release"):
        citygml.release_folder(spark, str(folder))


def test_census_workbooks(spark, tmp_path):
    for name, year in (("a", "Stand 2020"), ("b", "2021"), ("c", "none")):
        book = tmp_path / name
        book.mkdir()
        (book / "Titel.csv").write_text(f"Gitter 2019,x\n{census.YEAR_LABEL if name != 'c' else 'u'},{year}\n" if name != "c" else "x,y\n")
        (book / "Werte.csv").write_text(",".join(census.COLUMNS) + "\nN2001000E4001000,1,A,t,k,b,10,7,p\n")
    found = census.find_workbook(spark, str(tmp_path), 2020, "Titel")
    assert found.endswith("/a")
    got = census.read_workbook(spark, found, "Titel").first()
    assert (got.dataset_year, got.northing_m, got.experimental_population, got.source_sheet, got.grid_resolution_m) == (2020, 2001000, 7, "Werte", 1000)
    with pytest.raises(ValueError, match="asked for 2021"):
        census.read_workbook(spark, found, "Titel", 2021)
    with pytest.raises(ValueError, match="no workbook"):
        census.find_workbook(spark, str(tmp_path), 1999, "Titel")
    with pytest.raises(ValueError, match="no data sheet"):
        census.data_sheet(["Titel"], "Titel")


def test_methods_lines_and_reloaded_edges(spark):
    assert [sinks.method(x) for x in (None, " Trip-Stop ", "anytime", "RAPTOR")] == ["trip_stop", "trip_stop", "trip_stop_anytime", "raptor"]
    with pytest.raises(ValueError, match="called"):
        sinks.method("x")
    lines = lambda *x: spark.createDataFrame(list(enumerate(x)), "pos int, line string")
    assert [r.line for r in sinks.text_lines(lines("from A", "noise", "to B"), lines("ride"), ("from", "to")).collect()] == ["from A", "to B", "ride"]
    edges = spark.createDataFrame([("transfer", 2, 0, None, None, None, None), ("transfer", 2, 60, None, None, None, None), ("walk", None, 5, None, None, None, None), ("trip", None, 9, None, 7, "08:00:00", None)], "kind string, transfer_type int, weight int, dep int, arr int, dep_time string, arr_time string")
    assert sorted((r.kind, r.dep, r.arr) for r in sinks.reloaded_edges(edges).collect()) == [("station_link", None, None), ("transfer", None, None), ("trip", 28800, 7)]


def test_census_grid(spark):
    names = list(census.COLUMNS)
    rows = [("CRS3035RES1kmN2811000E4407000", "1", " A ", "t", "k", "b", "10", "[0-3]", "p"), ("CRS3035RES1kmN2812000E4407000", "1", "B", "t", "k", "b", "", "7", "p")]
    got = census.census_grid(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)), 2020).orderBy("northing_m").collect()
    assert [r.experimental_population for r in got] == [None, 7] and got[0].__fields__ == list(census.ORDER)
    assert 48 < got[0].cell_center_lat < 49.5 and 10.5 < got[0].cell_center_lon < 12 and got[0].municipality_name == "A"
    bad = spark.createDataFrame([("CELL-1", *rows[0][1:])], ", ".join(f"`{n}` string" for n in names))
    with pytest.raises(Exception, match="not a grid id"):
        census.census_grid(bad, 2020).collect()
    with pytest.raises(ValueError, match="AGS"):
        census.census_grid(bad.drop("AGS"), 2020)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, part string")
    sinks.replace_partitions(df, path, ["part"])
    sinks.replace_partitions(df.filter("part = 'a'").withColumn("v", F.lit(9)), path, ["part"])
    assert sorted((r.v, r.part) for r in spark.read.parquet(path).collect()) == [(2, "b"), (9, "a")]
    catalog, calls = sinks.Catalog(spark, str(tmp_path / "c")), []
    build = lambda: calls.append(1) or df
    for options in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert catalog.get_or_build("edges", "f", options, build).count() == 2
    assert len(calls) == 2
    feature = sinks.feature_collection(spark.createDataFrame([('{"type":"Point","coordinates":[1,2]}', 3)], "g string, n int"), "g", ["n"]).first()[0]
    assert feature == '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"n":3}}'


def test_streaming(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(1, 5), (2, 6)], "query_id long, depart int").write.parquet(str(source))
    stream = spark.readStream.schema("query_id long, depart int").parquet(str(source))
    q = answer_requests(stream, lambda b: b.withColumn("arrival", F.col("depart") + 1), str(out), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.arrival for r in spark.read.parquet(str(out)).collect()) == [6, 7]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert hourly_counts(events).agg(F.sum("n")).first()[0] == events.count()


def write_workbook(path, sheets, shared=True):
    """A small .xlsx file; sheets: name -> {row from 1: {column letter: value}}."""
    import zipfile
    from xml.sax.saxutils import escape

    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    strings: list[str] = []

    def cell(ref, v):
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if not shared:
            return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        strings.append(v)
        return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {main} {rel}><sheets>{listed}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(f"{c}{r}", v) for c, v in cells.items()) + "</row>" for r, cells in rows.items())
            size = f'<dimension ref="A1:J{max(rows)}"/>' if shared else ""
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}>{size}<sheetData>{body}</sheetData></worksheet>")
        if shared:
            items = "".join(f"<si><t>{escape(s)}</t></si>" if k % 2 else f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r><rPh><t>no</t></rPh></si>" for k, s in enumerate(strings))
            z.writestr("xl/sharedStrings.xml", f"<sst {main}>{items}</sst>")


@pytest.mark.parametrize("shared", [True, False])
def test_workbook_files(spark, tmp_path, shared):
    from tramline.sources import workbook

    path = str(tmp_path / "a.xlsx")
    rows = {r: {"A": f"k{r} & <x>", "C": r, "AB": r / 4, "D": r % 2 == 0} for r in range(1, 1001) if r % 10}
    write_workbook(path, {"one": {1: {"A": "x"}}, "two": rows}, shared)
    assert workbook.sheet_names(path) == ["one", "two"]
    got = workbook.read_sheet(spark, path, "two", rows=128)
    assert got.rdd.getNumPartitions() == (8 if shared else 1)
    found = {r.row: r.cells for r in got.collect()}
    assert set(found) == {r - 1 for r in rows}
    assert all(c[0] == f"k{r + 1} & <x>" and c[1] is None and c[2] == str(r + 1) and c[3] == str(r % 2 == 1).upper() and float(c[27]) == (r + 1) / 4 and len(c) == 28 for r, c in found.items())
    assert [r.cells for r in workbook.read_sheet(spark, path).collect()] == [["x"]]
    with pytest.raises(Exception, match="no sheet three"):
        workbook.read_sheet(spark, path, "three").collect()


def test_census_workbook_file(spark, tmp_path):
    letters, names = "ABCDEFGHI", list(census.COLUMNS)
    values = {2: ("CRS3035RES1kmN2725000E4321000", "01", "M", "t", "k", "b", 10, "[0-3]", "p"), 3: ("CRS3035RES1kmN2726000E4321000", "01", " ", "t", "k", "b", 10, "7", "p")}
    data = {1: dict(zip(letters, names))} | {r: dict(zip(letters, v)) for r, v in values.items()}
    for name, year in (("a", 2019), ("b", 2020)):
        write_workbook(str(tmp_path / f"{name}.xlsx"), {"Titel": {1: {"A": "Gitter 1999"}, 16: {"A": census.YEAR_LABEL, "B": year}}, "Werte": data})
    (tmp_path / "~a.xlsx").write_text("lock")
    (tmp_path / "readme.txt").write_text("no workbook")
    book = census.find_workbook(spark, str(tmp_path), 2020, "Titel")
    assert book.endswith("b.xlsx")
    rows = {r.northing_m: r for r in census.read_workbook(spark, book, "Titel", 2020).collect()}
    assert rows[2725000].experimental_population is None and rows[2726000].experimental_population == 7 and rows[2726000].municipality_name is None
    assert tuple(rows[2725000].asDict()) == census.ORDER and rows[2725000].source_sheet == "Werte" and rows[2725000].municipality_population == 10
    with pytest.raises(ValueError, match="asked for 2018"):
        census.read_workbook(spark, book, "Titel", 2018)
    write_workbook(str(tmp_path / "c.xlsx"), {"Titel": {1: {"A": f"{census.YEAR_LABEL} 2021"}}, "Werte": {1: {"A": "Gitter-ID"}}})
    with pytest.raises(ValueError, match="missing columns: AGS"):
        census.read_workbook(spark, str(tmp_path / "c.xlsx"), "Titel")


def test_catalogue_finds_only_whole_entries_of_what_is_asked_for(spark, tmp_path, caplog):
    import json
    from pathlib import Path

    built = []

    def build(n):
        built.append(n)
        return lambda: spark.range(n).selectExpr("id", "cast(null as string) as note")

    options = {"metres": 500, "speed": 0.7}
    one = sinks.Catalog(spark, str(tmp_path))
    get = lambda c, n, **o: c.get_or_build("walks", "f", options, build(n), **o)
    caplog.set_level("INFO", "tramline.sources.sinks")
    assert get(one, 10).count() == 10 and get(one, 11).count() == 10
    assert "written as entry 1, 10 rows" in caplog.text and "read from entry 1, 10 rows" in caplog.text
    assert one.get_or_build("walks", "f", {**options, "speed": 1.4}, build(3)).count() == 3
    # Another version of the library does not take the table, and the first one still does.
    two = sinks.Catalog(spark, str(tmp_path), "2")
    assert get(two, 20).count() == 20 and get(one, 21).count() == 10 and get(two, 22).count() == 20
    assert "another version" in caplog.text
    # A rebuild leaves what is being read.
    before = get(one, 0)
    assert get(one, 30, rebuild=True).count() == 30 and before.count() == 10 and get(one, 31).count() == 30
    # Damage is a miss: a truncated file, then an unreadable manifest, then a table without one.
    folder = Path(one.path("walks", "f", options))
    said = json.loads((folder / "manifest-3.json").read_text())
    part = folder / said["data"] / max(said["files"])
    part.write_bytes(part.read_bytes()[:-7])
    assert get(one, 40).count() == 10  # the entry before it is whole
    (folder / "manifest-1.json").write_text("{")
    for crc in folder.glob(".manifest-1.json.crc"):
        crc.unlink()
    assert get(one, 41).count() == 41 and "not whole" in caplog.text and "cannot be read" in caplog.text
    spark.range(5).write.parquet(str(folder / "data-lost"))
    assert get(one, 42).count() == 41
    assert one.vacuum("walks", "f", options) == 4 and get(one, 43).count() == 41
    assert [p.name for p in folder.glob("data-*") if p.is_dir()] == [json.loads((folder / "manifest-4.json").read_text())["data"]]
