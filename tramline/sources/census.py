"""Census grids: workbook files, or folders of one CSV file a sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import laea_to_wgs84
from ..functions.times import blank_to_null
from .gtfs import listed
from .workbook import read_sheet, sheet_names

# The workbook's column names.
COLUMNS = {
    "Gitter-ID": "grid_cell_id",
    "AGS": "ags",
    "Gemeinde": "municipality_name",
    "Bezeichnung": "municipality_type",
    "Kreis": "district_name",
    "Bundesland": "state_name",
    "Einwohnerzahl_pro_Gemeinde": "municipality_population",
    "Exp_georef_BFS_20": "experimental_population_raw",
    "Plausibilisierung": "plausibility_label",
}


# The order of the result's columns, and the label of the cell beside the year's.
ORDER = (
    "dataset_year", "grid_resolution_m", "grid_cell_id", "northing_m", "easting_m", "cell_center_lat", "cell_center_lon", "ags", "municipality_name",
    "municipality_type", "district_name", "state_name", "municipality_population", "experimental_population_raw", "experimental_population",
    "plausibility_label", "source_path", "source_sheet",
)
YEAR_LABEL = "Datenstand/Berichtsjahr"
RESOLUTION = 1_000
_YEAR = r"\b((?:19|20)\d{2})\b"


def sheets(spark: SparkSession, workbook: str) -> dict[str, str | None]:
    """Sheet name -> path, in order, of a workbook that was exported as a folder of one CSV file a sheet; without paths of an .xlsx
    file."""
    if workbook.endswith(".xlsx"):
        return dict.fromkeys(sheet_names(workbook))
    return {n[:-4]: p for n, p, is_file in listed(spark, workbook) if is_file and n.endswith(".csv")}


def sheet_table(spark: SparkSession, workbook: str, sheet: str) -> DataFrame:
    """A sheet's rows below its first one, which names the columns."""
    if not workbook.endswith(".xlsx"):
        return spark.read.option("header", True).csv(sheets(spark, workbook)[sheet])
    rows = read_sheet(spark, workbook, sheet)
    head = rows.filter("row = 0").first()
    named = [(i, n) for i, n in enumerate(head["cells"] if head else []) if n is not None]
    return rows.filter("row > 0").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in named])


def data_sheet(names: list[str], title: str) -> str:
    """The first sheet that is not the title sheet."""
    for name in names:
        if name != title:
            return name
    raise ValueError("the workbook has no data sheet")


def sheet_year(title: DataFrame) -> int | None:
    """The year on a title sheet of rows (row, cells): the last number in the row of YEAR_LABEL, else the first of the sheet."""
    rows = title.filter("row < 40").withColumn("said", F.array_join("cells", " "))
    years = lambda: F.regexp_extract_all("said", F.lit(_YEAR), F.lit(1))
    found = rows.select("row", F.col("said").contains(YEAR_LABEL).alias("labelled"), years().alias("years")).filter(F.size("years") > 0)
    best = found.agg(F.min_by(F.element_at("years", -1), F.when(F.col("labelled"), F.col("row"))).alias("a"), F.min_by(F.get("years", F.lit(0)), "row").alias("b"), F.max(F.col("labelled").cast("int")).alias("l")).first()
    year = best.a if best.l else best.b
    return int(year) if year else None


def workbook_year(spark: SparkSession, workbook: str, title: str) -> int:
    named, year = sheets(spark, workbook), None
    if title in named and workbook.endswith(".xlsx"):
        year = sheet_year(read_sheet(spark, workbook, title))
    elif title in named:
        rows = spark.read.option("header", False).csv(named[title]).withColumn("row", F.monotonically_increasing_id())
        year = sheet_year(rows.select("row", F.array_compact(F.array(*[c for c in rows.columns if c != "row"])).alias("cells")))
    if not year:
        raise ValueError(f"no year is given in {workbook}")
    return year


def find_workbook(spark: SparkSession, root: str, dataset_year: int, title: str) -> str:
    """The only workbook of the year in root: an .xlsx file or a folder; those that name no year are passed over."""
    found = []
    for name, path, is_file in listed(spark, root):
        if not is_file or name.endswith(".xlsx") and not name.startswith("~"):
            try:
                found += [path] if workbook_year(spark, path, title) == dataset_year else []
            except ValueError:
                continue
    if len(found) != 1:
        raise ValueError(f"{'several workbooks' if found else 'no workbook'} of {dataset_year} in {root}: {', '.join(found)}")
    return found[0]


def read_workbook(spark: SparkSession, workbook: str, title: str, dataset_year: int | None = None) -> DataFrame:
    """census_grid() of a workbook's data sheet; an error if it is not of the year asked for."""
    year = workbook_year(spark, workbook, title)
    if dataset_year not in (None, year):
        raise ValueError(f"asked for {dataset_year}, but {workbook} is of {year}")
    names = sheets(spark, workbook)
    sheet = data_sheet(list(names), title)
    return census_grid(sheet_table(spark, workbook, sheet), year, workbook, sheet)


def census_grid(sheet: DataFrame, dataset_year: int, source_path: str | None = None, source_sheet: str | None = None) -> DataFrame:
    """The sheet's columns by their short names, with year, grid corner, centre and population (null where masked), in ORDER.

    An error if columns are missing or a grid id does not end in N<digits>E<digits>."""
    if lacks := sorted(set(COLUMNS) - set(sheet.columns)):
        raise ValueError(f"missing columns: {', '.join(lacks)}")
    rows = sheet.select(*[blank_to_null(F.col(f"`{a}`").cast("string")).alias(b) for a, b in COLUMNS.items()]).filter("grid_cell_id is not null")
    good = F.col("grid_cell_id").rlike(r"N\d+E\d+$")
    part = lambda i: F.when(good, F.regexp_extract("grid_cell_id", r"N(\d+)E(\d+)$", i).cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a grid id: "), "grid_cell_id")).cast("int"))
    rows = rows.withColumn("northing_m", part(1)).withColumn("easting_m", part(2))
    lat, lon = laea_to_wgs84(F.col("easting_m") + RESOLUTION / 2, F.col("northing_m") + RESOLUTION / 2)
    number = lambda c: F.col(c).try_cast("double").cast("long")
    made = {"dataset_year": F.lit(dataset_year), "grid_resolution_m": F.lit(RESOLUTION), "municipality_population": number("municipality_population"), "experimental_population": number("experimental_population_raw"), "cell_center_lat": lat, "cell_center_lon": lon, "source_path": F.lit(source_path).cast("string"), "source_sheet": F.lit(source_sheet).cast("string")}
    return rows.withColumns(made).select(*ORDER)
