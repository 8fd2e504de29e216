"""The ingest in increments: only what is new is read into the tables, and nothing twice."""

import datetime as dt

from pyspark.sql import functions as F

from hourcast.plans import ingest
from hourcast.sources.trips import TRIP_SCHEMA
from hourcast.sources.weather import dedupe_payloads



def trips(spark, rows):
    """(file, start) rows as standard trips."""
    df = spark.createDataFrame([(f, dt.datetime.fromisoformat(t) if t else None) for f, t in rows], "source_file string, standardized_start_time timestamp_ntz")
    df = df.withColumn("start_date", F.to_date("standardized_start_time"))
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TRIP_SCHEMA])


def payloads(spark, rows):
    return spark.createDataFrame([(dt.datetime.fromisoformat(t), '{"data": [{"temp": %s}]}' % temp if temp is not None else '{"data": []}', o) for t, temp, o in rows],
                                 "datetime timestamp_ntz, payload string, received int")


def table(spark, out, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in spark.read.parquet(f"{out}/{name}").collect()))


def test_increments_add_up_to_one_run(spark, tmp_path):
    day = [("a", "2024-01-01 08:10:00"), ("a", "2024-01-01 08:20:00"), ("b", "2024-01-02 09:00:00"), ("b", None)]
    late = [*day, ("c", "2024-01-01 08:50:00"), ("c", "2024-01-03 07:00:00")]
    sky = [("2024-01-01 08:00:00", 1.0, 1), ("2024-01-02 09:00:00", 3.0, 1), ("2024-01-02 10:00:00", None, 1)]
    more = [*sky, ("2024-01-01 08:00:00", 99.0, 2), ("2024-01-01 09:00:00", 5.0, 1), ("2024-01-02 10:00:00", 7.0, 2), ("2024-01-03 07:00:00", 8.0, 1), ("2024-01-03 07:00:00", 9.0, 3)]
    out = str(tmp_path / "steps")
    assert ingest.run_increment(spark, trips(spark, day), payloads(spark, sky), out, order="received") == {"days": 2, "hours": 2}
    assert table(spark, out, "hourly", "datetime", "trip_count") == [(dt.datetime(2024, 1, 1, 8), 2), (dt.datetime(2024, 1, 2, 9), 1)]
    # a file with a late trip of a landed day, and hours that were missing
    assert ingest.run_increment(spark, trips(spark, late), payloads(spark, more), out, order="received") == {"days": 2, "hours": 3}
    hourly = [(dt.datetime(2024, 1, 1, 8), 3), (dt.datetime(2024, 1, 2, 9), 1), (dt.datetime(2024, 1, 3, 7), 1)]
    assert table(spark, out, "hourly", "datetime", "trip_count") == hourly
    weather = [(dt.datetime(2024, 1, 1, 8), 1.0), (dt.datetime(2024, 1, 1, 9), 5.0), (dt.datetime(2024, 1, 2, 9), 3.0), (dt.datetime(2024, 1, 2, 10), 7.0), (dt.datetime(2024, 1, 3, 7), 9.0)]
    assert table(spark, out, "weather", "datetime", "temp") == weather
    enriched = [(*h, dict(weather).get(h[0])) for h in hourly]
    assert table(spark, out, "enriched", "datetime", "trip_count", "temp") == enriched
    # nothing new: nothing written, nothing doubled
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "steps").rglob("*.parquet")}
    assert ingest.run_increment(spark, trips(spark, late), payloads(spark, more), out, order="received") == {"days": 0, "hours": 0}
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "steps").rglob("*.parquet")} == before
    assert table(spark, out, "files", "source_file") == [("a",), ("b",), ("c",)]


def test_a_run_cut_short_is_repeated(spark, tmp_path, monkeypatch):
    """The hourly table is written, the run ends before the file list: the next run writes the same days again."""
    rows = trips(spark, [("a", "2024-01-01 08:10:00"), ("a", "2024-01-02 08:10:00")])
    sky, out = payloads(spark, [("2024-01-01 08:00:00", 1.0, 1)]), str(tmp_path / "cut")
    whole = ingest.replace_days

    def stops(df, path, ts_col="datetime"):
        if path.endswith("weather"):
            raise RuntimeError("lost")
        whole(df, path, ts_col)

    monkeypatch.setattr(ingest, "replace_days", stops)
    try:
        ingest.run_increment(spark, rows, sky, out)
    except RuntimeError:
        pass
    monkeypatch.setattr(ingest, "replace_days", whole)
    assert ingest.run_increment(spark, rows, sky, out) == {"days": 2, "hours": 1}
    assert table(spark, out, "hourly", "datetime", "trip_count") == [(dt.datetime(2024, 1, 1, 8), 1), (dt.datetime(2024, 1, 2, 8), 1)]
    assert table(spark, out, "enriched", "datetime", "temp") == [(dt.datetime(2024, 1, 1, 8), 1.0), (dt.datetime(2024, 1, 2, 8), None)]


def test_newest_payload_by_order(spark):
    rows = [("2024-01-01 08:00:00", 1, 1), ("2024-01-01 08:00:00", 2, 3), ("2024-01-01 08:00:00", 4, 3), ("2024-01-01 08:00:00", 0, None), ("2024-01-01 09:00:00", 6, None)]
    got = {r["datetime"].hour: r["payload"] for r in dedupe_payloads(payloads(spark, rows), order="received").collect()}
    assert got == {8: '{"data": [{"temp": 2}]}', 9: '{"data": [{"temp": 6}]}'}
    assert {r["payload"] for r in dedupe_payloads(payloads(spark, rows)).collect()} == {'{"data": [{"temp": 0}]}', '{"data": [{"temp": 6}]}'}


def test_empty_folder(spark, tmp_path):
    out = str(tmp_path / "none")
    assert ingest.run_increment(spark, trips(spark, []), payloads(spark, []), out) == {"days": 0, "hours": 0}
