"""Readers of observation tables and documents."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.operators.cleaning import coerce_time
from gaugeflow.schemas import OBSERVATION_TEXT

# Column names of the published station list.
STATION_LIST_COLUMNS = {
    "station_name": "Station Name",
    "river_name": "River Name",
    "basin": "Basin Name",
    "state": "State name",
    "district": "District / Town",
    "latitude": "Latitude",
    "longitude": "longitude",
    "division": "Division Name",
    "site_type": "Type Of Site",
}


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, so that there is one kind of missing value."""
    numbers = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in numbers}) if numbers else df


def read_observations(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """Observation files with the fixed columns; `observation_time` is added from the text.

    Columns are found by their names in the header, in any order; absent ones are NULL, others are
    left out, and text that is no number counts as missing."""
    if file_format == "csv":
        found = spark.read.option("header", True).csv(path)
        columns = [
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in found.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in OBSERVATION_TEXT.fields
        ]
        rows = found.select(*columns)
    else:
        rows = spark.read.schema(OBSERVATION_TEXT).format(file_format).load(path)
    return coerce_time(missing_as_null(rows), "timestamp")


def newest_file(spark: SparkSession, pattern: str) -> str | None:
    """The file with the largest name; only the listing is read, no content."""
    names = spark.read.format("binaryFile").load(pattern).select("path")
    return names.agg(F.max("path")).first()[0]


def newest_batch(rows: DataFrame, batch: str) -> DataFrame:
    """Rows of the newest batch; with `batch` a partition column the filter prunes partitions."""
    return rows.filter(F.col(batch) == rows.agg(F.max(batch).alias("m")).scalar())


def station_master(
    listing: DataFrame, ordinal: str, columns: Mapping[str, str] = STATION_LIST_COLUMNS
) -> DataFrame:
    """Station list to canonical names; the id is STN_ and the zero-padded row ordinal."""
    station_id = F.format_string("STN_%04d", F.col(ordinal))
    found = [F.col(f"`{source}`").alias(name) for name, source in columns.items() if source in listing.columns]
    return listing.select(station_id.alias("station_id"), *found)


def first_with_rows(primary: DataFrame | None, secondary: DataFrame) -> DataFrame:
    """The primary source unless it has no row at all."""
    return secondary if primary is None or primary.isEmpty() else primary


def read_documents(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Document texts with the file they came from; one per line, or one per file."""
    rows = spark.read.text(path, wholetext=whole_files)
    return rows.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("json"))


_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'  # outside of quotes


def file_profile(spark: SparkSession, path: str) -> DataFrame:
    """file_name, valid, records, columns and error of each csv file below a path.

    The listing is joined with what the lines of each file say, so every file has its row and its
    own column count: a file without lines has no records and no columns, one with a record wider
    than its header or with bytes that are no UTF-8 text has an error of its own and spoils no
    other. Blank lines don't count; quotes may hold commas but no line breaks.
    """
    files = spark.read.option("pathGlobFilter", "*.csv").text(path)
    # Scans skip files without bytes, so the names are those of the listing that any read makes.
    listed = spark.createDataFrame([(unquote(f.rsplit("/", 1)[-1]),) for f in files.inputFiles()], "file_name string")
    lines = files.select(
        F.col("_metadata.file_name").alias("file_name"), "value", F.size(F.split("value", _COMMA)).alias("fields"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
    seen = lines.filter(F.trim("value") != "").groupBy("file_name").agg(
        F.count(F.lit(1)).alias("lines"), F.min_by("fields", "at").alias("columns"), F.max("fields").alias("widest"),
        F.max(~F.is_valid_utf8("value")).alias("garbled"))
    error = (
        F.when(F.col("lines").isNull(), "no columns to read")
        .when(F.col("garbled"), "not UTF-8 text")
        .when(F.col("widest") > F.col("columns"), F.format_string("expected %d fields, saw %d", "columns", "widest"))
    )
    return listed.join(seen, "file_name", "left").select(
        "file_name", error.isNull().alias("valid"), F.coalesce(F.col("lines") - 1, F.lit(0)).alias("records"),
        F.coalesce("columns", F.lit(0)).alias("columns"), error.alias("error"))


TASK_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """Let all cores share an input whose files are too few to occupy them, in tasks of bounded size.

    For work that is heavy per row. Only an input with fewer splits than cores, or than
    one for each TASK_ROWS rows, is moved; anything else is left alone.
    """
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return df
    wanted = max(spark.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    if len(files) >= wanted:
        return df
    split = 128 * 1024 * 1024
    sizes = spark.read.format("binaryFile").load(files).select(F.ceil(F.col("length") / split).alias("n"))
    return df.repartition(wanted) if sizes.agg(F.sum("n")).first()[0] < wanted else df
