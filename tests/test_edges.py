import datetime as dt

import pandas as pd

from hourcast.operators.aggregate import top_station
from hourcast.operators.features import mode_of, preprocess
from hourcast.operators.windows import RN


def test_mode_and_station_ties(spark):
    assert mode_of([("Rain", 3), ("Clear", 3), ("Mist", 1)]) == "Clear"
    rows = [("f", dt.datetime(2024, 1, 1, h), s, 1.0 * h, 2.0) for h, s in enumerate(["B", "A", "B", "A"])]
    trips = spark.createDataFrame(rows, "source_file string, standardized_start_time timestamp_ntz, "
                                        "start_station_id string, start_lat double, start_lng double")
    t = top_station(trips).first()
    assert t["start_station_id"] == "A" and t["station_trips"] == 2 and t["latitude"] == 1.0  # first A trip


def test_unparseable_datetime_and_gaps(spark):
    pdf = pd.DataFrame({
        "datetime": ["2024-01-01 00:00:00", "2024-01-01 01:00:00", "garbage", "2024-01-01 05:00:00",
                     "2024-01-01 06:00:00"],
        "trip_count": [10, 20, 30, 40, 50],
    })
    feats, st = preprocess(spark.createDataFrame(pdf), "base")
    got = feats.orderBy(RN).toPandas()
    # the unparseable stamp sorts last (NaT last) and its calendar flags are 0
    assert got["trip_count"].tolist() == [10, 20, 40, 50, 30]
    assert pd.isna(got["datetime"].iloc[-1]) and got["is_night"].iloc[-1] == 0
    # lags are positional: the 05:00 row lags the 01:00 row across the gap
    assert got["trip_count_lag_1"].iloc[2] == 20
    # hour_of_day of the bad row was null and is filled with the median of the rest
    assert got["hour_of_day"].iloc[-1] == pd.Series([0, 1, 5, 6]).median()


def test_fill_hour_gaps_dense_grid(spark):
    from hourcast.operators.aggregate import fill_hour_gaps

    rows = [("a", dt.datetime(2024, 1, 1, 0), 3), ("a", dt.datetime(2024, 1, 1, 3), 5),
            ("b", dt.datetime(2024, 1, 6, 23), 1)]
    hourly = spark.createDataFrame(rows, "s string, datetime timestamp_ntz, trip_count long")
    got = sorted((r["s"], r["datetime"].hour, r["trip_count"], r["is_weekend"])
                 for r in fill_hour_gaps(hourly, ["s"]).collect())
    assert got == [("a", 0, 3, 0), ("a", 1, 0, 0), ("a", 2, 0, 0), ("a", 3, 5, 0), ("b", 23, 1, 1)]


def test_preprocess_fill_gaps_makes_lags_hourly(spark):
    pdf = pd.DataFrame({"datetime": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 01:00", "2024-01-01 04:00"]),
                        "trip_count": [10, 20, 40], "temp": [1.0, 2.0, 4.0]})
    feats, st = preprocess(spark.createDataFrame(pdf), "base", fill_gaps=True)
    got = feats.orderBy("datetime").toPandas()
    assert got["trip_count"].tolist() == [10, 20, 0, 0, 40]
    assert got["trip_count_lag_3"].iloc[4] == 20       # 3 hours back, not 3 rows back
    assert got["temp"].iloc[2] == 2.0                  # filled hour: weather imputed by the median


def test_cluster_without_a_shared_folder_is_an_error():
    import types

    import pytest
    from hourcast.session import checkpoint_dir

    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d: None), sparkContext=context)
    with pytest.raises(RuntimeError):
        checkpoint_dir(session)
