"""Plan-shape guards for the scale design (read with ``explain``)."""

import re

from hourcast.operators.features import SPECS
from hourcast.operators.windows import add_row_index, halo_window, lag_sql
from hourcast.plans.ingest import driver_hourly

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hourly_count_prunes_and_pre_aggregates(spark):
    from hourcast.operators.aggregate import hour_and_station_counts
    from hourcast.sources.trips import driver_trips

    plan = _plan(hour_and_station_counts(driver_trips(spark, SF, include_legacy=False)))
    scans = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert scans == ["struct<ts:timestamp_ntz,user_id:bigint>"]  # the columns of the one pass
    assert "partial_count" in plan                                # map-side combine before the shuffle


def test_positional_windows_shuffle_by_block_not_single_partition(spark):
    spec = SPECS["h2"]
    h = add_row_index(driver_hourly(spark, SF).select("datetime", "trip_count"), "datetime")
    out = halo_window(h, [], lambda w: lag_sql("trip_count", w, spec.lags, spec.ma, spec.std, spec.diff),
                      back=spec.reach, sql=True)
    plan = _plan(out)
    assert "hashpartitioning(_blk" in plan and "hashpartitioning(_bkt" in plan
    # the window over the data is keyed by block; a SinglePartition exchange may
    # only feed the small per-week counts table (and the one-row station lookup)
    window_lines = [l for l in plan.split("\n") if "Window [" in l and "trip_count_lag_1" in l]
    assert window_lines


def test_raw_trips_are_read_once(spark):
    """Hourly counts, top station and days come from one aggregate; its plan scans ``events`` once, and
    what is derived from it not at all."""
    from hourcast.operators.aggregate import daily_and_hourly, hour_and_station_counts, hourly_trips
    from hourcast.sources.trips import driver_trips

    sf = "/root/testdata/sf0.001"
    trips = driver_trips(spark, sf, include_legacy=False)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(hour_and_station_counts(trips)).count("FileScan parquet") == 1
    for df in (hourly_trips(trips), hourly_trips(trips, ["rideable_type"]), daily_and_hourly(trips)[0]):
        assert "events.parquet" not in plan(df)


def test_holidays_join_nothing(spark):
    from pyspark.sql import functions as F

    from hourcast.functions.calendar import with_is_holiday

    df = with_is_holiday(spark.range(10).select(F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("datetime")))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
