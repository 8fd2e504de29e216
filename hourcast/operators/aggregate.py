"""Trip aggregation (AG-1..4, AG-8, PRJ-3/4/10, JN-3, FLT-4, TK-5).

Counts are plain ``groupBy().count()``: Spark pre-aggregates on the map side
(``partial_count``), so a hot hour or day costs one row per map task in the
shuffle, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourcast.functions.calendar import floor_hour, is_weekend_of, weekday_mon0
from hourcast.session import cut_lineage

START = "standardized_start_time"


def daily_trips(trips: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """Trips per day with calendar columns (AG-1, PRJ-3, PRJ-10)."""
    s = list(series_cols)
    daily = (trips.where(F.col("start_date").isNotNull())
             .groupBy(*s, F.col("start_date").alias("date"))
             .agg(F.count(F.lit(1)).alias("trip_count")))
    dow = weekday_mon0("date")
    return daily.select(*s, "date", "trip_count",
                        dow.alias("day_of_week"),
                        F.month("date").alias("month"),
                        is_weekend_of(dow).alias("is_weekend"))


def hour_and_station_counts(trips: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """Counts per hour and counts per station from one scan: ``(series…, datetime, start_station_id, n, first,
    by_hour)``, rows of hours and rows of stations. A task sends as many rows as it has seen hours and
    stations, not their combinations. ``first`` is the smallest (source_file, start time, lat, lng)."""
    s = list(series_cols)
    told = trips.select(*s, floor_hour(START).alias("datetime"), "start_station_id",
                        F.struct("source_file", START, "start_lat", "start_lng").alias("_first"))
    sets = told.groupingSets([[*s, "datetime"], [*s, "start_station_id"]], *s, "datetime", "start_station_id")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.min("_first").alias("first"), (F.grouping("start_station_id") == 1).alias("by_hour"))


def hourly_counts(trips: DataFrame, series_cols: Sequence[str] = (), ts_col: str = START) -> DataFrame:
    """Trips per hour (AG-2): ``(series…, datetime, trip_count)``."""
    s = list(series_cols)
    return (trips.where(F.col(ts_col).isNotNull())
            .groupBy(*s, floor_hour(ts_col).alias("datetime"))
            .agg(F.count(F.lit(1)).alias("trip_count")))


def top_of(groups: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """Top station from counts per station, or any finer split of them."""
    s = list(series_cols)
    per_station = (groups.where(F.col("start_station_id").isNotNull()).groupBy(*s, "start_station_id")
                   .agg(F.sum("n").alias("station_trips"), F.min("first").alias("first")))
    best = per_station.groupBy(*s).agg(
        F.min_by(F.struct("start_station_id", "station_trips", "first"),
                 F.struct(-F.col("station_trips"), F.col("start_station_id"))).alias("_top"))
    return best.select(*s,
                       F.col("_top.start_station_id").alias("start_station_id"),
                       F.col("_top.station_trips").alias("station_trips"),
                       F.col("_top.first.start_lat").alias("latitude"),
                       F.col("_top.first.start_lng").alias("longitude"))


def top_station(trips: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """Most used start station and the coordinates of its first trip (AG-4, TK-5).

    Ties on the count go to the lowest station id; "first trip" is the
    smallest (source_file, start time, lat, lng), a deterministic stand-in for
    file order. All steps are mergeable aggregates (no global sort).
    """
    s = list(series_cols)
    first = F.min(F.struct("source_file", START, "start_lat", "start_lng")).alias("first")
    return top_of(trips.groupBy(*s, "start_station_id").agg(F.count(F.lit(1)).alias("n"), first), s)


def hourly_trips(trips: DataFrame, series_cols: Sequence[str] = (), with_coords: bool = True) -> DataFrame:
    """Hourly series with calendar columns and top-station coordinates
    (AG-2, PRJ-4, PRJ-10, AG-4, FLT-4, TK-5, JN-3).

    The trips are read once: counts per hour and counts per station are written to the
    shared folder, a row per hour and a row per station.
    The coordinate table has one row per series: with one system-wide series its
    two values are literals; with many series AQE picks broadcast or
    shuffle from its runtime size (the number of series is not bounded).
    """
    s = list(series_cols)
    coords = with_coords and "start_station_id" in trips.columns
    if coords:
        groups = cut_lineage(hour_and_station_counts(trips, s))
        hourly = groups.where("by_hour and datetime is not null").select(*s, "datetime", F.col("n").alias("trip_count"))
        stations = groups.where("not by_hour")
    else:
        hourly = hourly_counts(trips, s)
    dow = weekday_mon0("datetime")
    hourly = hourly.select(*s, "datetime", "trip_count",
                           F.hour("datetime").alias("hour"),
                           F.dayofmonth("datetime").alias("day"),
                           dow.alias("day_of_week"),
                           F.month("datetime").alias("month"),
                           is_weekend_of(dow).alias("is_weekend"))
    if coords and s:
        return hourly.join(top_of(stations, s).select(*s, "latitude", "longitude"), on=s, how="left")
    top = top_of(stations).first() if coords else None
    at = {c: F.lit(top[c] if top else None).cast("double") for c in ("latitude", "longitude")}
    return hourly.withColumns(at)


#: Hours of a grid that are generated as one array.
GRID = 8192


def hour_grid(span: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """``(series…, datetime)``: every hour from ``_lo`` to ``_hi`` of each row. Hours are generated in blocks of
    ``GRID``, so one bad date makes more rows, not an array of all of them."""
    s = list(series_cols)
    hours = "CAST((unix_seconds(CAST(_hi AS TIMESTAMP)) - unix_seconds(CAST(_lo AS TIMESTAMP))) DIV 3600 AS BIGINT)"
    blocks = span.where("_lo IS NOT NULL").select(*s, "_lo", "_hi", F.explode(F.expr(f"sequence(0L, {hours} DIV {GRID})")).alias("_b"))
    first = f"_lo + make_dt_interval(0, CAST(_b * {GRID} AS INT), 0, 0)"
    last = f"least(_hi, _lo + make_dt_interval(0, CAST(_b * {GRID} + {GRID - 1} AS INT), 0, 0))"
    return blocks.select(*s, F.explode(F.expr(f"sequence({first}, {last}, INTERVAL 1 HOUR)")).alias("datetime"))


def fill_hour_gaps(hourly: DataFrame, series_cols: Sequence[str] = (), value: str = "trip_count") -> DataFrame:
    """Optional dense hourly grid (``fill_gaps``): every hour between each
    series' first and last hour, missing hours counted as 0, calendar columns
    recomputed, other columns null.

    Hours with no trips have no row after aggregation, so positional lags are
    "k rows back". On the dense grid they are "k hours back". The grid is
    generated per series from its own min/max (a one-row-per-series
    aggregate), and its size equals the dense hourly grain.
    """
    s = list(series_cols)
    span = hourly.groupBy(*s).agg(F.min("datetime").alias("_lo"), F.max("datetime").alias("_hi"))
    grid = hour_grid(span, s)
    calendar = {"hour", "day", "day_of_week", "month", "is_weekend"}
    rest = [c for c in hourly.columns if c not in {*s, "datetime", value, *calendar}]
    dense = grid.join(hourly.select(*s, "datetime", value, *rest), on=[*s, "datetime"], how="left")
    dow = weekday_mon0("datetime")
    return dense.select(*s, "datetime", F.coalesce(F.col(value), F.lit(0)).alias(value),
                        F.hour("datetime").alias("hour"), F.dayofmonth("datetime").alias("day"),
                        dow.alias("day_of_week"), F.month("datetime").alias("month"),
                        is_weekend_of(dow).alias("is_weekend"), *rest)


def daily_and_hourly(trips: DataFrame, series_cols: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Daily and hourly aggregates from one scan (AG-3): days are sums over the hourly counts."""
    s = list(series_cols)
    hourly = cut_lineage(hourly_trips(trips, s))
    daily = hourly.groupBy(*s, F.to_date("datetime").alias("date")).agg(F.sum("trip_count").alias("trip_count"))
    dow = weekday_mon0("date")
    return daily.select(*s, "date", "trip_count", dow.alias("day_of_week"), F.month("date").alias("month"),
                        is_weekend_of(dow).alias("is_weekend")), hourly


def distinct_hours(df: DataFrame, ts_col: str = "datetime") -> DataFrame:
    """Distinct timestamps (AG-8); sort only at the sink if order is needed."""
    return df.select(ts_col).where(F.col(ts_col).isNotNull()).distinct()
