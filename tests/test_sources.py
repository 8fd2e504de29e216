import datetime as dt
import os
import tempfile

import pytest

from hourcast.operators.aggregate import daily_trips, hourly_trips, top_station
from hourcast.sources.trips import load_trip_data
from hourcast.sources.weather import parse_forecast, parse_weather


def _write(d, name, text):
    with open(os.path.join(d, name), "w") as f:
        f.write(text)


def test_two_header_generations_and_unknown(spark):
    d = tempfile.mkdtemp()
    _write(d, "new.csv", "ride_id,started_at,ended_at,start_station_id,start_lat,start_lng\n"
                         "a,2024-01-01 08:10:00,2024-01-01 08:30:00,S1,42.1,-71.1\n"
                         "b,2024-01-01 08:50:00,2024-01-01 09:10:00,S2,42.2,-71.2\n"
                         "c,not a time,2024-01-01 09:10:00,S1,42.1,-71.1\n")
    _write(d, "old.csv", '"tripduration","starttime","stoptime","start station id",'
                         '"start station latitude","start station longitude"\n'
                         '100,1/1/2024 8:05,1/1/2024 8:20,S1,42.1,-71.1\n'
                         '100,2024-01-02 09:00:00,2024-01-02 09:20:00,S3,42.3,-71.3\n')
    _write(d, "junk.csv", "foo,bar\n1,2\n")
    with pytest.warns(UserWarning):
        scan = load_trip_data(spark, d)
    assert [os.path.basename(p) for p in scan.skipped] == ["junk.csv"]
    trips = scan.trips
    assert trips.count() == 5
    assert {r[0] for r in trips.select("source_file").distinct().collect()} == {"new.csv", "old.csv"}
    hourly = {r["datetime"]: r["trip_count"] for r in hourly_trips(trips).collect()}
    assert hourly == {dt.datetime(2024, 1, 1, 8): 3, dt.datetime(2024, 1, 2, 9): 1}
    top = top_station(trips).first()
    assert top["start_station_id"] == "S1" and top["station_trips"] == 3 and top["latitude"] == 42.1
    daily = {r["date"]: r["trip_count"] for r in daily_trips(trips).collect()}
    assert daily == {dt.date(2024, 1, 1): 3, dt.date(2024, 1, 2): 1}


def test_no_usable_file(spark):
    d = tempfile.mkdtemp()
    _write(d, "junk.csv", "foo,bar\n1,2\n")
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        load_trip_data(spark, d)


def test_weather_payload_polymorphism(spark):
    w = '{"temp": 280.0, "humidity": 50, "sunrise": 0, "weather": [{"id": 500, "main": "Rain"}], '
    rows = [
        (dt.datetime(2024, 1, 1, 1), '{"timezone": "X", "timezone_offset": 5, "data": [' + w + '"rain": {"1h": 1.5}}]}'),
        (dt.datetime(2024, 1, 1, 2), '{"data": [' + w + '"rain": 2.5, "snow": {"3h": 9}}]}'),
        (dt.datetime(2024, 1, 1, 3), '{"data": [{"temp": 281.0}]}'),
        (dt.datetime(2024, 1, 1, 4), '{"data": []}'),
    ]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, payload string")
    got = {r["datetime"].hour: r for r in parse_weather(df, temp_unit="kelvin").collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["rain_1h"] == 1.5 and got[2]["rain_1h"] == 2.5 and got[3]["rain_1h"] == 0.0
    assert got[2]["snow_1h"] == 0.0 and got[3]["weather_main"] is None and got[1]["weather_id"] == 500
    assert abs(got[1]["temp"] - 6.85) < 1e-9 and got[1]["sunrise"] == dt.datetime(1970, 1, 1)
    assert got[1]["timezone_offset"] == 5


def test_forecast_rows_and_window(spark):
    p = ('{"list": [{"dt": 1704103200, "main": {"temp": 5.0, "humidity": 80}, "weather": [{"main": "Snow"}],'
         ' "snow": {"1h": 0.4}}, {"dt": 1704114000, "main": {"temp": 4.0, "humidity": 90}}]}')
    df = spark.createDataFrame([(p,)], "payload string")
    rows = parse_forecast(df, "2024-01-01 09:00:00", 3).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["datetime"] == dt.datetime(2024, 1, 1, 10) and r["dew_point"] == 5.0 - 20 / 5
    assert r["snow_1h"] == 0.4 and r["rain_1h"] == 0.0 and r["uvi"] == 0.0 and r["day_of_week"] == 0


def test_bad_and_malformed_files(spark, tmp_path):
    import pytest
    from hourcast.sources.trips import load_trip_data

    (tmp_path / "a.csv").write_text("started_at,ended_at,start_station_id\n2023-01-01 00:00:00,2023-01-01 00:10:00,1\nbroken,line\n")
    (tmp_path / "b.csv").write_text("starttime,stoptime,start station id\n2023-01-02 00:00:00,2023-01-02 00:10:00,2\n")
    (tmp_path / "c.csv").write_text("who,knows\n1,2\n")
    with pytest.warns(UserWarning):
        scan = load_trip_data(spark, str(tmp_path))
    assert [s.rsplit("/", 1)[1] for s in scan.skipped] == ["c.csv"]
    assert {r["source_file"]: (r["rows"], r["malformed_rows"]) for r in scan.report.collect()} == {"a.csv": (2, 1), "b.csv": (1, 0)}
    assert {r["source_file"] for r in scan.trips.select("source_file").collect()} == {"a.csv", "b.csv"}


def test_headers_of_many_files_come_from_one_job(spark, tmp_path):
    """2,000 files, both generations, an empty one, a byte order mark and a quoted header: one job, no file opened by the driver."""
    from hourcast.sources import trips as source

    new, old = "started_at,ended_at,start_station_id", 'starttime,stoptime,"start station id"'
    for i in range(2000):
        (tmp_path / f"f{i:04}.csv").write_text(("﻿" if i == 7 else "") + (new if i % 3 else old) + f"\n2023-01-01 00:{i % 60:02}:00,,{i}\n")
    (tmp_path / "empty.csv").write_text("")
    paths = source._list_csv(spark, str(tmp_path))
    sc = spark.sparkContext
    sc.setJobGroup("headers", "headers")
    try:
        told = source.header_lines(spark, paths)
        jobs = sc.statusTracker().getJobIdsForGroup("headers")
    finally:
        sc._jsc.clearJobGroup()
    assert len(jobs) <= 3  # the listing of so many paths, the scan and the reduced lines
    assert len(told) == 2000 and told["f0007.csv"] == new.split(",") and told["f0000.csv"] == ["starttime", "stoptime", "start station id"]


def test_one_bad_file_among_many_costs_few_jobs(spark, tmp_path, monkeypatch):
    import gzip

    from hourcast.sources import trips as source

    for i in range(40):
        (tmp_path / f"f{i:02}.csv").write_text("started_at,ended_at\n2023-01-01 00:00:00,\n")
    whole = gzip.compress(b"started_at,ended_at\n" + b"2023-01-01 00:00:00,2023-01-01 00:10:00\n" * 5000)
    (tmp_path / "f99.csv.gz").write_bytes(whole[: len(whole) // 2])
    paths = [*source._list_csv(spark, str(tmp_path)), f"file:{tmp_path}/f99.csv.gz"]
    read, calls = source.unreadable, []
    monkeypatch.setattr(source, "unreadable", lambda s, p: (calls.append(len(p)), read(s, p))[1])
    with pytest.warns(UserWarning):
        assert source.unreadable(spark, paths) == paths[-1:]
    assert len(calls) <= 2 * 6 + 1 and source.unreadable(spark, paths[:-1]) == []


def test_quarantine_lists_what_holds_no_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("started_at,ended_at,start_station_id\n2023-01-01 00:00:00,x,1\nbroken,line\nnever,2023-01-01 00:00:00,\"a,b\"\n,,\n")
    (tmp_path / "b.csv").write_text("starttime,stoptime,start station id\n1/2/2023 3:04,y,2\n1,2,3,4\n")
    scan = load_trip_data(spark, str(tmp_path))
    got = sorted((r["source_file"], r["reason"], r["line"]) for r in scan.quarantine.collect())
    assert got == [("a.csv", "malformed", "broken,line"), ("a.csv", "start_time", ",,"), ("a.csv", "start_time", 'never,2023-01-01 00:00:00,"a,b"'), ("b.csv", "malformed", "1,2,3,4")]
    assert scan.trips.count() == 6
