"""Trip sources (SRC-1..5, PRJ-1/2, ST-1, SNK-1/2/3).

Trip CSVs come in two header generations. Each distinct header line is read
with its own all-string schema (so column order and extra columns never
matter), every generation is mapped onto one standard trip frame, and the
parts are unioned by name. Files whose header names neither generation are
skipped and reported.
"""

from __future__ import annotations

import csv
import io
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.functions.calendar import weekday_mon0

# Fixed header names of the two trip CSV generations.
NEW_HEADER = {
    "start": "started_at",
    "end": "ended_at",
    "station": "start_station_id",
    "lat": "start_lat",
    "lng": "start_lng",
}
LEGACY_HEADER = {
    "start": "starttime",
    "end": "stoptime",
    "station": "start station id",
    "lat": "start station latitude",
    "lng": "start station longitude",
}

# Accepted timestamp layouts, tried in order after Spark's default parser.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSS",
    "yyyy-MM-dd HH:mm",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
)

TRIP_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("standardized_start_time", T.TimestampNTZType()),
    T.StructField("standardized_end_time", T.TimestampNTZType()),
    T.StructField("start_date", T.DateType()),
    T.StructField("start_hour", T.IntegerType()),
    T.StructField("start_day_of_week", T.IntegerType()),
    T.StructField("start_month", T.IntegerType()),
    T.StructField("start_station_id", T.StringType()),
    T.StructField("start_lat", T.DoubleType()),
    T.StructField("start_lng", T.DoubleType()),
])


def parse_timestamp(c: Column | str, formats=TIMESTAMP_FORMATS) -> Column:
    """String → TIMESTAMP_NTZ, null when no layout matches (FN-DT1, coerce)."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.trim(c.cast("string"))
    tries = [F.try_to_timestamp(s)] + [F.try_to_timestamp(s, F.lit(f)) for f in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


def as_timestamp(df: DataFrame, name: str) -> Column:
    """Column of any input type as TIMESTAMP_NTZ (strings are parsed)."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp_ntz")
    return parse_timestamp(F.col(name))


def generation_of(columns) -> dict | None:
    cols = set(columns)
    if NEW_HEADER["start"] in cols:
        return NEW_HEADER
    if LEGACY_HEADER["start"] in cols:
        return LEGACY_HEADER
    return None


def standardize_trips(raw: DataFrame, source_file: Column | str | None = None,
                      keep: tuple[str, ...] = ("rideable_type",)) -> DataFrame:
    """Map one header generation onto the standard trip frame (PRJ-1, PRJ-2).

    Columns named in ``keep`` (e.g. a series key) pass through when present."""
    gen = generation_of(raw.columns)
    if gen is None:
        raise ValueError(f"unknown trip header: {raw.columns}")
    if source_file is None:
        src = F.lit(None).cast("string")
    elif isinstance(source_file, str):
        src = F.lit(source_file)
    else:
        src = source_file

    def opt(name: str, dtype: str) -> Column:
        if name in raw.columns:
            return F.col(f"`{name}`").cast(dtype) if dtype != "double" else F.col(f"`{name}`").try_cast("double")
        return F.lit(None).cast(dtype)

    start = as_timestamp(raw, gen["start"])
    end = as_timestamp(raw, gen["end"]) if gen["end"] in raw.columns else F.lit(None).cast("timestamp_ntz")
    return raw.select(
        src.alias("source_file"),
        start.alias("standardized_start_time"),
        end.alias("standardized_end_time"),
        opt(gen["station"], "string").alias("start_station_id"),
        opt(gen["lat"], "double").alias("start_lat"),
        opt(gen["lng"], "double").alias("start_lng"),
        *[F.col(f"`{k}`") for k in keep if k in raw.columns],
    ).select(
        "source_file", "standardized_start_time", "standardized_end_time",
        F.to_date("standardized_start_time").alias("start_date"),
        F.hour("standardized_start_time").alias("start_hour"),
        weekday_mon0("standardized_start_time").alias("start_day_of_week"),
        F.month("standardized_start_time").alias("start_month"),
        "start_station_id", "start_lat", "start_lng",
        *[k for k in keep if k in raw.columns],
    )


def union_trips(parts: list[DataFrame]) -> DataFrame:
    """Vertical union of trip frames with differing columns (ST-1)."""
    if not parts:
        raise ValueError("there is no trip file with a known header")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- CSV files

@dataclass
class TripScan:
    trips: DataFrame
    #: (source_file, rows, malformed_rows) of every file that was scanned
    report: DataFrame
    #: (source_file, line, reason) of the records that hold no trip: ``malformed`` or ``start_time``
    quarantine: DataFrame
    headers: dict[tuple, list[str]] = field(default_factory=dict)
    #: files left out as a whole: unknown headers, and bad files with ``on_bad_file="skip"``
    skipped: list[str] = field(default_factory=list)


def _list_csv(spark: SparkSession, directory: str) -> list[str]:
    """List ``*.csv`` under a directory through the Hadoop filesystem API, so
    local, HDFS and object-store paths behave the same."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(directory.rstrip("/") + "/*.csv")
    fs = pattern.getFileSystem(conf)
    statuses = fs.globStatus(pattern) or []
    return sorted(str(s.getPath().toString()) for s in statuses if s.isFile())


def header_lines(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """File name to the fields of its first line; one job for all files, empty files are left out.

    A file's first block lies in one task, in order, so its first line is the one with the smallest row
    number there; later blocks are filtered out by the scan's metadata, and lines are reduced before
    they leave a task."""
    if not paths:
        return {}
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("i"))
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "i").alias("line"))
    return {r["file"]: next(csv.reader(io.StringIO(r["line"].lstrip("\ufeff"))), []) for r in first.collect()}


def unreadable(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files that cannot be read to their end. All are read in one job; only where it fails are the halves
    read on their own, so a bad file costs as many jobs as the list can be halved."""
    if not paths:
        return []
    try:
        spark.read.text(paths).write.format("noop").mode("overwrite").save()
        return []
    except Exception as exc:  # whatever the codec or the file system throws
        if len(paths) == 1:
            warnings.warn(f"{paths[0]} cannot be read to its end: {exc}")
            return paths
    half = len(paths) // 2
    return unreadable(spark, paths[:half]) + unreadable(spark, paths[half:])


CORRUPT = "_corrupt_record"


def load_trip_data(spark: SparkSession, directory: str, on_bad_file: str = "fail") -> TripScan:
    """Scan every trip CSV of a directory (SRC-1..4).

    Files are grouped by their exact header; each group is one CSV scan with
    an explicit all-string schema. Malformed rows are kept with nulls
    (PERMISSIVE) and counted per file in ``TripScan.report``; they, and rows whose
    start time cannot be read, are listed in ``TripScan.quarantine``. A file that
    cannot be read fails the scan; with ``on_bad_file="skip"`` all files are read
    once beforehand, and one that fails is left out as a whole and listed in
    ``TripScan.skipped``.
    """
    if on_bad_file not in ("fail", "skip"):
        raise ValueError("on_bad_file is fail or skip")
    paths = _list_csv(spark, directory)
    skipped = unreadable(spark, paths) if on_bad_file == "skip" else []
    paths = [p for p in paths if p not in set(skipped)]
    told = header_lines(spark, paths)
    headers = [told.get(p.rsplit("/", 1)[-1]) for p in paths]
    groups: dict[tuple, list[str]] = {}
    for p, header in zip(paths, headers):
        if not header or generation_of(header) is None:
            warnings.warn(f"{p} has neither of the known headers and is left out")
            skipped.append(p)
            continue
        groups.setdefault(tuple(header), []).append(p)
    parts, reports, bad = [], [], []
    for header, files in groups.items():
        schema = T.StructType([T.StructField(h, T.StringType()) for h in (*header, CORRUPT)])
        reader = (spark.read.schema(schema)
                  .option("header", True)
                  .option("mode", "PERMISSIVE")
                  .option("columnNameOfCorruptRecord", CORRUPT))
        raw = reader.csv(files)
        parts.append(standardize_trips(raw.drop(CORRUPT), F.col("_metadata.file_name")))
        # whole lines, for a scan of some columns does not see that others are missing; it may not read
        # the malformed text alone, so rows are counted by the first column
        raw = reader.option("columnPruning", False).csv(files)
        bad.append(_without_trip(raw, list(header)))
        first = F.col(f"`{header[0]}`")
        reports.append(raw.groupBy(F.col("_metadata.file_name").alias("source_file")).agg(
            (F.count(first) + F.count_if(first.isNull())).alias("rows"), F.count(CORRUPT).alias("malformed_rows")))
    trips = union_trips(parts)
    report, quarantine = reports[0], bad[0]
    for r, b in zip(reports[1:], bad[1:]):
        report, quarantine = report.unionByName(r), quarantine.unionByName(b)
    return TripScan(trips, report, quarantine, groups, skipped)


def _without_trip(raw: DataFrame, header: list[str]) -> DataFrame:
    """(source_file, line, reason) of malformed records, and of records without a readable start time."""
    start = generation_of(header)["start"]
    rows = raw.select(F.col("_metadata.file_name").alias("source_file"), F.col(CORRUPT).alias("_bad"), parse_timestamp(f"`{start}`").alias("_start"),
                      F.to_csv(F.struct(*(F.col(f"`{h}`") for h in header))).alias("_line"))
    reason = F.when(F.col("_bad").isNotNull(), "malformed").when(F.col("_start").isNull(), "start_time")
    return rows.select("source_file", F.coalesce("_bad", "_line").alias("line"), reason.alias("reason")).where(F.col("reason").isNotNull())


# ---------------------------------------------- driver tables as trip files

def _station_lat(key: Column) -> Column:
    return (F.lit(42.30) + (key % 100) / F.lit(1000.0)).cast("double")


def _station_lng(key: Column) -> Column:
    return (F.lit(-71.10) - (key % 37) / F.lit(1000.0)).cast("double")


def events_as_new_header(events: DataFrame) -> DataFrame:
    """``events`` rows as new-header trips (one ride per event)."""
    uid = F.col("user_id")
    return events.select(
        F.col("event_id").cast("string").alias("ride_id"),
        F.col("event_type").alias("rideable_type"),
        F.col("ts").cast("timestamp_ntz").alias("started_at"),
        F.col("ts").cast("timestamp_ntz").alias("ended_at"),
        uid.cast("string").alias("start_station_id"),
        _station_lat(uid).alias("start_lat"),
        _station_lng(uid).alias("start_lng"),
    )


def orders_as_legacy_header(orders: DataFrame) -> DataFrame:
    """``orders`` rows as legacy-header trips (midnight start stamps)."""
    key = F.col("o_custkey")
    return orders.select(
        F.col("o_orderdate").cast("timestamp_ntz").alias("starttime"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("stoptime"),
        key.cast("string").alias("start station id"),
        _station_lat(key).alias("start station latitude"),
        _station_lng(key).alias("start station longitude"),
    )


def driver_trips(spark: SparkSession, sf_dir: str, include_legacy: bool = True) -> DataFrame:
    """Standard trip frame over the driver tables: events (new header) ∪ orders (legacy)."""
    from hourcast.sources.tables import read_table

    parts = [standardize_trips(events_as_new_header(read_table(spark, sf_dir, "events")), "events")]
    if include_legacy:
        parts.append(standardize_trips(orders_as_legacy_header(read_table(spark, sf_dir, "orders")), "orders"))
    return union_trips(parts)


# ----------------------------------------------------------- enriched / sinks

def read_hourly_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Hourly or enriched CSV with ``datetime`` coerced to TIMESTAMP_NTZ (SRC-5)."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if "datetime" in df.columns:
        df = df.withColumn("datetime", as_timestamp(df, "datetime"))
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Sink for the hourly, enriched and weather-summary tables (SNK-1..3)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
