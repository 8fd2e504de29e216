import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from hourcast.plans.ingest import run_ingest
from hourcast.streaming.hourly import hourly_counts_stream, start_hourly_sink, trip_stream


def _csv(d, name, rows):
    with open(os.path.join(d, name), "w") as f:
        f.write("ride_id,rideable_type,started_at,ended_at,start_station_id,start_lat,start_lng\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def test_streaming_hourly_counts_finalise_by_watermark(spark):
    landing, out, ck = (tempfile.mkdtemp() for _ in range(3))
    _csv(landing, "a.csv", [("1", "classic", "2024-01-01 08:10:00", "", "S1", "42", "-71"),
                            ("2", "classic", "2024-01-01 08:20:00", "", "S1", "42", "-71"),
                            ("3", "classic", "2024-01-01 09:05:00", "", "S1", "42", "-71")])
    _csv(landing, "b.csv", [("4", "classic", "2024-01-01 13:00:00", "", "S1", "42", "-71")])
    counts = hourly_counts_stream(trip_stream(spark, landing, max_files_per_trigger=1), watermark="1 hour")
    q = start_hourly_sink(counts, out, ck)
    q.awaitTermination(120)
    got = {r["datetime"]: r["trip_count"] for r in spark.read.parquet(out).collect()}
    # hours 08 and 09 are final once the 13:00 trip moved the watermark past them
    assert got.get(dt.datetime(2024, 1, 1, 8)) == 2 and got.get(dt.datetime(2024, 1, 1, 9)) == 1
    assert dt.datetime(2024, 1, 1, 13) not in got  # still open


def test_file_ingest_round_trip(spark):
    trips, out = tempfile.mkdtemp(), tempfile.mkdtemp()
    _csv(trips, "t.csv", [("1", "e", "2024-01-01 08:10:00", "", "S1", "42.1", "-71.1"),
                          ("2", "e", "2024-01-01 09:20:00", "", "S1", "42.1", "-71.1")])
    payloads = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 8), '{"data": [{"temp": 3.0, "rain": {"1h": 0.5}}]}'),
         (dt.datetime(2024, 1, 1, 8), '{"data": [{"temp": 3.0, "rain": {"1h": 0.5}}]}')],  # repeated hour
        "datetime timestamp_ntz, payload string")
    paths = run_ingest(spark, trips, payloads, out, fmt="csv")
    enr = spark.read.option("header", True).option("inferSchema", True).csv(paths["enriched"])
    rows = {r["datetime"].hour: r for r in enr.collect()}
    assert set(rows) == {8, 9} and rows[8]["temp"] == 3.0 and rows[9]["temp"] is None
    assert rows[8]["trip_count"] == 1 and rows[8]["latitude"] == 42.1
    assert sorted(r["rain_1h"] for r in enr.collect() if r["rain_1h"] is not None) == [0.5]
    assert spark.read.option("header", True).csv(paths["weather"]).count() == 1
