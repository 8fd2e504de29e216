"""Registered queries over the driver tables.

Every query reads the parquet tables of ``sf_dir`` (or data Spark derives from
them) and returns a DataFrame. ``presented`` is the output convention shared
with the DuckDB oracles: doubles rounded to 6 digits, dates shown as midnight
TIMESTAMP_NTZ, columns aliased to the oracle names.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.functions.calendar import calendar_columns, cyclical, holiday_table, with_is_holiday
from hourcast.functions.sqlexpr import q
from hourcast.operators import analysis, metrics, scaling, sequences, topk
from hourcast.operators.aggregate import daily_and_hourly, daily_trips, distinct_hours, fill_hour_gaps, hourly_trips, top_station
from hourcast.operators.features import SPECS, materialized_features
from hourcast.operators.windows import RN, add_row_index, halo_window, lag_columns
from hourcast.plans.ingest import DAY, driver_enriched, driver_forecast, driver_hourly, driver_weather, landed, payload_versions, run_increment
from hourcast.session import cut_lineage, files_key, session_key
from hourcast.sources.tables import read_table as read_table_
from hourcast.sources.trips import driver_trips
from hourcast.sources.weather import dedupe_payloads, parse_weather

SERIES = ["rideable_type"]  # event_type of the events table
HORIZON = 2
SEQ_LEN = 12


def presented(df: DataFrame, all_double: bool = False, keep: Sequence[str] = (),
              doubles: Sequence[str] = ("weather_id", "timezone_offset")) -> DataFrame:
    """Round doubles to 6 digits, show dates as timestamps; optionally cast
    every numeric column (except ``keep``) to double first. Nullable integer
    columns listed in ``doubles`` are shown as double (pandas has no null int)."""
    exprs = []
    for f in df.schema.fields:
        c = q(f.name)
        t = f.dataType
        numeric = isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                                 T.DoubleType, T.DecimalType))
        if numeric and ((all_double and f.name not in keep) or f.name in doubles):
            c, t = f"CAST({c} AS DOUBLE)", T.DoubleType()
        if isinstance(t, (T.DoubleType, T.FloatType)):
            c = f"round(CAST({c} AS DOUBLE), 6)"
        elif isinstance(t, T.DateType):
            c = f"CAST({c} AS TIMESTAMP_NTZ)"
        exprs.append(f"{c} AS {q(f.name)}")
    return df.selectExpr(*exprs)


def memo_key(spark: SparkSession, sf: str) -> tuple:
    """What the tables below are kept by: session, folder, and the files the folder holds."""
    return session_key(spark), sf, files_key(spark, sf, ("events", "orders"))


_HOURLY: dict = {}


def hourly_table(spark: SparkSession, sf: str, series: Sequence[str] = (), include_legacy: bool = False) -> DataFrame:
    """The hourly grain of the driver tables, aggregated once per (session,
    folder, series) and written to the shared checkpoint folder. Window
    operators branch over their input (row index counts, split counts);
    reading the checkpoint keeps that from re-scanning the raw trips."""
    key = (memo_key(spark, sf), tuple(series), include_legacy)
    if key not in _HOURLY:
        _HOURLY[key] = cut_lineage(driver_hourly(spark, sf, series, include_legacy=include_legacy))
    return _HOURLY[key]


_ENRICHED: dict = {}


def enriched_table(spark: SparkSession, sf: str, series: Sequence[str] = ()) -> DataFrame:
    """Hourly trips ⟕ weather, built once per (session, folder, series) and
    checkpointed; feature fitting and every scoring call read it."""
    key = (memo_key(spark, sf), tuple(series))
    if key not in _ENRICHED:
        _ENRICHED[key] = cut_lineage(driver_enriched(spark, sf, series))
    return _ENRICHED[key]


# ------------------------------------------------------------- ingest queries

def q_trips_standardized(spark: SparkSession, sf: str) -> DataFrame:
    return presented(driver_trips(spark, sf, include_legacy=True))


def q_daily_trips(spark: SparkSession, sf: str) -> DataFrame:
    return presented(daily_trips(driver_trips(spark, sf, include_legacy=True)))


def q_hourly_trips(spark: SparkSession, sf: str) -> DataFrame:
    return presented(driver_hourly(spark, sf))


def q_hourly_trips_union(spark: SparkSession, sf: str) -> DataFrame:
    return presented(driver_hourly(spark, sf, include_legacy=True))


def q_hourly_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    """File path end to end (SRC-1..4, ST-1): ``events`` and ``orders`` are
    written as trip CSVs of the two header generations into the shared
    checkpoint folder, scanned back with header dispatch, counted per hour."""
    import uuid

    from hourcast.session import checkpoint_dir
    from hourcast.sources.trips import events_as_new_header, load_trip_data, orders_as_legacy_header

    folder = f"{checkpoint_dir(spark)}/trips-{uuid.uuid4().hex}"
    fmt = {"header": True, "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    # one folder with files of both generations
    events_as_new_header(read_table_(spark, sf, "events")).write.options(**fmt).csv(folder)
    orders_as_legacy_header(read_table_(spark, sf, "orders")).write.mode("append").options(**fmt).csv(folder)
    return presented(hourly_trips(load_trip_data(spark, folder).trips))


def q_trips_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Records without a trip (SRC-3): ``events`` as CSV lines in which error events end early and purchases of
    50 and more have no readable start, scanned back through the header dispatch."""
    import uuid

    from hourcast.session import checkpoint_dir
    from hourcast.sources.trips import load_trip_data

    folder = f"{checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    stamp = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"
    start = f"CASE WHEN event_type = 'purchase' AND value >= 50 THEN concat('at ', event_id) ELSE {stamp} END"
    line = f"CASE WHEN event_type = 'error' THEN concat_ws(',', event_id, event_type, {stamp}) ELSE concat_ws(',', event_id, event_type, {start}, {stamp}, user_id) END"
    rows = read_table_(spark, sf, "events").selectExpr(f"{line} AS value")
    # whole lines as the one column of a CSV, so that every file has the header line
    rows = rows.withColumnRenamed("value", "ride_id,rideable_type,started_at,ended_at,start_station_id")
    rows.write.option("header", True).option("sep", "\u0001").csv(folder)
    return load_trip_data(spark, folder).quarantine.select("line", "reason")


def q_weather_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Weather rows from the newest of several payloads an hour (ST-4)."""
    return presented(parse_weather(dedupe_payloads(payload_versions(spark, sf), order="received")))


def q_ingest_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The enriched table after three increments, read back from its sink (SRC-5, SNK-1..3, ST-4): a file a day up
    to the middle of the time, then all files, then all again."""
    import uuid

    from hourcast.session import checkpoint_dir

    trips = driver_trips(spark, sf, include_legacy=False).withColumn("source_file", F.col("start_date").cast("string"))
    payloads = payload_versions(spark, sf)
    ends = trips.agg(F.min("start_date").alias("lo"), F.max("start_date").alias("hi")).first()
    out = f"{checkpoint_dir(spark)}/increments-{uuid.uuid4().hex}"
    if ends["lo"] is not None:
        middle = F.lit(ends["lo"] + (ends["hi"] - ends["lo"]) / 2)
        run_increment(spark, trips.where(F.col("start_date") <= middle), payloads.where(F.to_date("datetime") <= middle), out, order="received")
    run_increment(spark, trips, payloads, out, order="received")
    run_increment(spark, trips, payloads, out, order="received")
    return presented(landed(spark, f"{out}/enriched").drop(DAY))


def q_daily_from_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Daily totals that share the hourly aggregate's scan (AG-3)."""
    daily, _ = daily_and_hourly(driver_trips(spark, sf, include_legacy=True))
    return presented(daily)


def q_distinct_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Hours that weather is asked for (AG-8)."""
    return distinct_hours(driver_hourly(spark, sf, SERIES))


def q_correlation_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation over pairwise complete rows of a table with nulls (AG-19)."""
    return presented(analysis.correlation_long(enriched_table(spark, sf), ["trip_count", "temp", "rain_1h", "humidity"]))


def q_hourly_by_series(spark: SparkSession, sf: str) -> DataFrame:
    return presented(driver_hourly(spark, sf, SERIES))


def q_hourly_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Dense hourly grid per series with zero-count hours (fill_gaps option)."""
    hourly = hourly_table(spark, sf, SERIES).select(*SERIES, "datetime", "trip_count")
    return presented(fill_hour_gaps(hourly, SERIES))


def q_top_station(spark: SparkSession, sf: str) -> DataFrame:
    return presented(top_station(driver_trips(spark, sf, include_legacy=True)))


def q_weather_rows(spark: SparkSession, sf: str) -> DataFrame:
    return presented(driver_weather(spark, sf))


def q_enriched_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return presented(driver_enriched(spark, sf))


#: The forecast is asked for at midnight so many days after the first event, for so many hours.
FORECAST_DAYS, FORECAST_HOURS = 9, 168


def q_forecast_rows(spark: SparkSession, sf: str) -> DataFrame:
    first = read_table_(spark, sf, "events").agg(F.to_date(F.min("ts")).alias("d")).first()["d"]
    now = f"{first + timedelta(days=FORECAST_DAYS)} 00:00:00" if first is not None else "2000-01-01 00:00:00"
    return presented(driver_forecast(spark, sf, now, FORECAST_HOURS))


def q_means_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls of the weather columns as the column's mean (AG-7, FN-NU6)."""
    cols = ["temp", "humidity", "wind_speed", "rain_1h"]
    return presented(sequences.fill_with_means(enriched_table(spark, sf).select("datetime", *cols), cols))


def q_column_types(spark: SparkSession, sf: str) -> DataFrame:
    """Kind and nulls of every column of the enriched table (AG-10, AG-11)."""
    return analysis.column_types(enriched_table(spark, sf))


def q_holiday_calendar(spark: SparkSession, sf: str) -> DataFrame:
    trips = driver_trips(spark, sf, include_legacy=True)
    years = trips.select(F.year("start_date").alias("year")).distinct()
    return presented(holiday_table(years))


# ------------------------------------------------------------ feature queries

def q_calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    hourly = hourly_table(spark, sf).select("datetime", "trip_count")
    out = with_is_holiday(hourly, "datetime").withColumns(calendar_columns("datetime"))
    cyc = {}
    for name, src, period in (("hour", "hour_of_day", 24), ("day", "day", 31), ("month", "month", 12),
                              ("day_of_week", "day_of_week", 7)):
        cyc[f"{name}_sin"], cyc[f"{name}_cos"] = cyclical(F.col(src), period)
    return presented(out.withColumns(cyc))


def q_lag_features_series(spark: SparkSession, sf: str) -> DataFrame:
    spec = SPECS["h2"]
    hourly = hourly_table(spark, sf, SERIES).select(*SERIES, "datetime", "trip_count")
    idx = add_row_index(hourly, "datetime", SERIES)
    out = halo_window(idx, SERIES, lambda w: lag_columns("trip_count", w, spec.lags, spec.ma, spec.std,
                                                          spec.diff), back=spec.reach)
    return presented(out.drop(RN), all_double=True, keep=SERIES)


_FEATURES: dict = {}


def features(spark: SparkSession, sf: str, spec: str = "h2", series: Sequence[str] = ()):
    """Fitted feature table of the driver tables, materialised once per
    (session, folder, spec) into the shared checkpoint folder and reused by
    every query built on it (the feature table is the pipeline's shared
    intermediate, as a written table would be in production)."""
    key = (memo_key(spark, sf), spec, tuple(series))
    if key not in _FEATURES:
        _FEATURES[key] = materialized_features(enriched_table(spark, sf, series), spec, series)
    return _FEATURES[key]


def q_features_h2(spark: SparkSession, sf: str) -> DataFrame:
    df, _ = features(spark, sf, "h2")
    return presented(df.drop(RN), all_double=True)


def q_features_base(spark: SparkSession, sf: str) -> DataFrame:
    df, _ = features(spark, sf, "base")
    return presented(df.drop(RN), all_double=True)


def q_features_h3(spark: SparkSession, sf: str) -> DataFrame:
    df, _ = features(spark, sf, "h3")
    return presented(df.drop(RN), all_double=True)


def q_features_h24(spark: SparkSession, sf: str) -> DataFrame:
    df, _ = features(spark, sf, "h24")
    return presented(df.drop(RN), all_double=True)


def q_null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return presented(analysis.null_profile(driver_enriched(spark, sf)))


def q_target_profile(spark: SparkSession, sf: str) -> DataFrame:
    return presented(analysis.target_profile(driver_enriched(spark, sf)))


# ------------------------------------------------------ scaling and sequences

def _scaled(spark: SparkSession, sf: str):
    df, st = features(spark, sf, "h2")
    fitted = scaling.fit_scalers(df, st.feature_names, "trip_count")
    return df, st, fitted


def q_scaler_params(spark: SparkSession, sf: str) -> DataFrame:
    df, st, fitted = _scaled(spark, sf)
    return presented(scaling.params_frame(spark, fitted))


def q_scaled_features(spark: SparkSession, sf: str) -> DataFrame:
    df, st, fitted = _scaled(spark, sf)
    out = scaling.transform(df, fitted, keep=["datetime"])
    return presented(out, all_double=True)


def q_sequences(spark: SparkSession, sf: str) -> DataFrame:
    hourly = add_row_index(hourly_table(spark, sf).select("datetime", "trip_count"), "datetime")
    seq = sequences.build_sequences(hourly, ["trip_count"], "trip_count", SEQ_LEN, HORIZON,
                                    flatten=False)
    return presented(sequences.sequence_columns(seq, SEQ_LEN).drop(RN), all_double=True)


def q_multi_step_targets(spark: SparkSession, sf: str) -> DataFrame:
    hourly = add_row_index(hourly_table(spark, sf).select("datetime", "trip_count"), "datetime")
    out = sequences.multi_step_targets(hourly, "trip_count", 6)
    return presented(out.drop(RN), all_double=True)


def q_chrono_split(spark: SparkSession, sf: str) -> DataFrame:
    hourly = add_row_index(hourly_table(spark, sf, SERIES).select(*SERIES, "datetime", "trip_count"),
                           "datetime", SERIES)
    seq = sequences.build_sequences(hourly, ["trip_count"], "trip_count", SEQ_LEN, HORIZON, SERIES,
                                    flatten=False)
    split = sequences.chronological_split(seq.select(*SERIES, "datetime", RN, "target"), SERIES)
    return presented(split.drop(RN), all_double=True, keep=SERIES + ["split", "seq_index"])


# -------------------------------------------------------- metrics / analysis

def _persistence(spark: SparkSession, sf: str, series: Sequence[str] = ()) -> DataFrame:
    """Actual vs a persistence forecast made HORIZON hours earlier."""
    hourly = add_row_index(hourly_table(spark, sf, series).select(*series, "datetime", "trip_count"),
                           "datetime", series)
    return metrics.persistence_forecast(hourly, "trip_count", HORIZON, series)


def q_metrics_persistence(spark: SparkSession, sf: str) -> DataFrame:
    return presented(metrics.regression_metrics(_persistence(spark, sf)))


def q_metrics_per_horizon(spark: SparkSession, sf: str) -> DataFrame:
    hourly = add_row_index(hourly_table(spark, sf).select("datetime", "trip_count"), "datetime")
    long = metrics.persistence_by_horizon(hourly, "trip_count", 6)
    return presented(metrics.regression_metrics(long, group_cols=["hours_ahead"]))


def q_ensemble_metrics(spark: SparkSession, sf: str) -> DataFrame:
    pred = _persistence(spark, sf).withColumn(
        "member", F.when(F.weekday("target_time") >= 5, F.lit("weekend")).otherwise(F.lit("weekday")))
    return presented(metrics.pooled_metrics(pred, "member"))


def q_residuals(spark: SparkSession, sf: str) -> DataFrame:
    return presented(metrics.residual_series(_persistence(spark, sf), n_samples=200))


def _importance(spark: SparkSession, sf: str):
    df, st = features(spark, sf, "h2")
    imp = analysis.linear_importance(df, st.feature_names, "trip_count", HORIZON)
    return df, st, imp


def q_importance_top(spark: SparkSession, sf: str) -> DataFrame:
    _, _, imp = _importance(spark, sf)
    return presented(topk.top_importance(imp, 15))


def q_category_importance(spark: SparkSession, sf: str) -> DataFrame:
    _, _, imp = _importance(spark, sf)
    return presented(analysis.category_importance(imp, "h2"))


def q_correlation_top(spark: SparkSession, sf: str) -> DataFrame:
    df, st, imp = _importance(spark, sf)
    top = [r["feature"] for r in topk.top_importance(imp, 15).collect()]
    return presented(analysis.correlation_long(df, top + ["trip_count"]))


def q_unexpected_features(spark: SparkSession, sf: str) -> DataFrame:
    df, st, imp = _importance(spark, sf)
    return presented(analysis.unexpected_features(df, imp, "trip_count", top_n=15))


def q_last_hours(spark: SparkSession, sf: str) -> DataFrame:
    hourly = hourly_table(spark, sf, SERIES)
    return presented(topk.last_n(hourly, 24, SERIES))


def q_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    hourly = hourly_table(spark, sf)
    return presented(topk.first_rows(hourly, 20))


REGISTRY = {
    "trips_standardized": q_trips_standardized,
    "daily_trips": q_daily_trips,
    "hourly_trips": q_hourly_trips,
    "hourly_trips_union": q_hourly_trips_union,
    "hourly_by_series": q_hourly_by_series,
    "hourly_from_csv": q_hourly_from_csv,
    "daily_from_hourly": q_daily_from_hourly,
    "trips_quarantine": q_trips_quarantine,
    "means_filled": q_means_filled,
    "column_types": q_column_types,
    "weather_dedup": q_weather_dedup,
    "ingest_round_trip": q_ingest_round_trip,
    "distinct_hours": q_distinct_hours,
    "correlation_nulls": q_correlation_nulls,
    "hourly_filled": q_hourly_filled,
    "top_station": q_top_station,
    "weather_rows": q_weather_rows,
    "enriched_hourly": q_enriched_hourly,
    "forecast_rows": q_forecast_rows,
    "holiday_calendar": q_holiday_calendar,
    "calendar_features": q_calendar_features,
    "lag_features_series": q_lag_features_series,
    "features_h2": q_features_h2,
    "features_base": q_features_base,
    "features_h3": q_features_h3,
    "features_h24": q_features_h24,
    "null_profile": q_null_profile,
    "target_profile": q_target_profile,
    "scaler_params": q_scaler_params,
    "scaled_features": q_scaled_features,
    "sequences": q_sequences,
    "multi_step_targets": q_multi_step_targets,
    "chrono_split": q_chrono_split,
    "metrics_persistence": q_metrics_persistence,
    "metrics_per_horizon": q_metrics_per_horizon,
    "ensemble_metrics": q_ensemble_metrics,
    "residuals": q_residuals,
    "importance_top": q_importance_top,
    "category_importance": q_category_importance,
    "correlation_top": q_correlation_top,
    "unexpected_features": q_unexpected_features,
    "last_hours": q_last_hours,
    "first_rows": q_first_rows,
}
