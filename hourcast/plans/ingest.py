"""Entry A: trips → daily / hourly aggregates → weather join → sinks (§3.1).

One lazy plan: scans → union → partial/final hash aggregate → left join →
write. The driver-table variants map ``events`` (new header) and ``orders``
(legacy header) onto trip files and derive the hourly weather payloads from
``events``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.operators.aggregate import hourly_trips
from hourcast.session import cut_lineage
from hourcast.sources.tables import read_table
from hourcast.sources.trips import driver_trips, load_trip_data, read_hourly_csv, write_table
from hourcast.sources.weather import (add_weather, compose_forecast_payloads, compose_weather_payloads,
                                      dedupe_payloads, events_hourly_weather, parse_forecast, parse_weather)


def driver_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather rows parsed from payloads composed out of ``events``."""
    events = read_table(spark, sf_dir, "events")
    return parse_weather(compose_weather_payloads(events_hourly_weather(events)))


def payload_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(datetime, payload, received)``: every hour's weather payload, and one received before it that was made
    without the ``view`` events."""
    events = read_table(spark, sf_dir, "events")
    early = compose_weather_payloads(events_hourly_weather(events.where("event_type <> 'view'")))
    full = compose_weather_payloads(events_hourly_weather(events))
    return early.withColumn("received", F.lit(1)).unionByName(full.withColumn("received", F.lit(2)))


def driver_forecast(spark: SparkSession, sf_dir: str, now: str | None = None,
                    hours_ahead: int | None = None) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return parse_forecast(compose_forecast_payloads(events_hourly_weather(events)), now, hours_ahead)


def driver_hourly(spark: SparkSession, sf_dir: str, series_cols: Sequence[str] = (),
                  include_legacy: bool = False) -> DataFrame:
    return hourly_trips(driver_trips(spark, sf_dir, include_legacy=include_legacy), series_cols)


def driver_enriched(spark: SparkSession, sf_dir: str, series_cols: Sequence[str] = ()) -> DataFrame:
    """Hourly trips LEFT JOIN hourly weather over the driver tables (F7)."""
    return add_weather(driver_hourly(spark, sf_dir, series_cols), driver_weather(spark, sf_dir))


def run_ingest(spark: SparkSession, trips_dir: str, weather_payloads: DataFrame, out_dir: str,
               series_cols: Sequence[str] = (), fmt: str = "parquet") -> dict[str, str]:
    """File-based ingest: trip CSV folder + landed weather payloads → hourly,
    enriched and weather-summary tables (SNK-1..3)."""
    scan = load_trip_data(spark, trips_dir)
    hourly = hourly_trips(scan.trips, series_cols)
    weather = parse_weather(dedupe_payloads(weather_payloads))  # ST-4: one payload per hour
    paths = {"hourly": f"{out_dir}/hourly_trips_aggregated",
             "enriched": f"{out_dir}/hourly_trips_with_weather",
             "weather": f"{out_dir}/weather_data_summary"}
    write_table(hourly, paths["hourly"], fmt)
    # re-scan the written hourly table (SRC-5: ``datetime`` coerced to TIMESTAMP_NTZ)
    hourly_back = (read_hourly_csv(spark, paths["hourly"]) if fmt == "csv"
                   else spark.read.format(fmt).load(paths["hourly"]))
    write_table(add_weather(hourly_back, weather), paths["enriched"], fmt)
    write_table(weather, paths["weather"], fmt)
    return paths


# ------------------------------------------------------------ in increments

DAY = "landed_day"


def landed(spark: SparkSession, path: str) -> DataFrame | None:
    """The table below ``path``, or None before its first rows were written."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [] if not fs.exists(p) else [s.getPath().getName() for s in fs.listStatus(p)]
    return spark.read.parquet(path) if any(n[0] not in "_." for n in parts) else None


def replace_days(df: DataFrame, path: str, ts_col: str = "datetime") -> None:
    """Write the days that ``df`` holds, each as a whole; other days of the table stay (SNK-1..3). Writing the
    same rows again changes nothing."""
    days = df.withColumn(DAY, F.to_date(ts_col))
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def run_increment(spark: SparkSession, trips: DataFrame, payloads: DataFrame, out_dir: str,
                  series_cols: Sequence[str] = (), order: str | None = None) -> dict[str, int]:
    """One increment of the ingest over a landing folder that only grows (SRC-5, SNK-1..3, ST-4).

    ``trips`` are all trips of the folder, ``payloads`` all ``(datetime, payload[, order])`` rows. Three tables
    grow below ``out_dir``, in partitions by day, and a list of the files that are in them:

    * hourly: days that a new file has trips of are counted anew from all files, other days are not touched;
    * weather: hours that are not landed yet, from their newest payload, beside those that are;
    * enriched: hourly with weather, for the days that either has changed.

    The file list is written last. A run that was cut short is repeated by the next one; a rerun without new
    files and hours writes nothing. Returns how many days and hours were written.
    """
    paths = {n: f"{out_dir}/{n}" for n in ("hourly", "weather", "enriched", "files")}
    known = landed(spark, paths["files"])
    files = trips.select("source_file").where(F.col("source_file").isNotNull()).distinct()
    files = cut_lineage(files if known is None else files.join(known, "source_file", "left_anti"))
    new = trips.where("start_date is not null").join(files, "source_file", "left_semi")
    days = cut_lineage(new.select(F.col("start_date").alias(DAY)).distinct())
    counted = trips.join(days, trips.start_date == days[DAY], "left_semi")
    # the top station's coordinates are a statistic of all trips, not of an increment
    hourly = cut_lineage(hourly_trips(counted, series_cols, with_coords=False).drop("latitude", "longitude"))

    old = landed(spark, paths["weather"])
    fresh = payloads.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    if old is not None:
        fresh = fresh.join(old.select("datetime"), "datetime", "left_anti")
    fresh = cut_lineage(parse_weather(dedupe_payloads(fresh, order=order)))
    hours = cut_lineage(fresh.select(F.to_date("datetime").alias(DAY)).distinct())
    beside = [] if old is None else [old.join(hours, DAY, "left_semi").drop(DAY)]
    weather = fresh
    for rows in beside:
        weather = weather.unionByName(rows)
    weather = cut_lineage(weather)  # read before its own days are replaced

    written = {"days": days.count(), "hours": fresh.count()}
    if written["days"]:
        replace_days(hourly, paths["hourly"])
    if written["hours"]:
        replace_days(weather, paths["weather"])
    if written["days"] or written["hours"]:
        changed = days.unionByName(hours).distinct()
        base, sky = landed(spark, paths["hourly"]), landed(spark, paths["weather"])
        if base is not None:
            base = base.join(changed, DAY, "left_semi").drop(DAY)
            told = fresh.limit(0) if sky is None else sky.join(changed, DAY, "left_semi").drop(DAY)
            replace_days(cut_lineage(add_weather(base, told)), paths["enriched"])
    if files.limit(1).count():
        files.write.mode("append").parquet(paths["files"])
    return written
