import datetime as dt

from pyspark.sql import functions as F

from hourcast.functions.calendar import calendar_columns, holiday_table, weekday_mon0, with_is_holiday


def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 7),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(weekday_mon0("t")).collect()] == [0, 6]


def test_holidays_2024_and_observed(spark):
    years = spark.createDataFrame([(2021,), (2022,), (2024,)], "year int")
    got = {r[0] for r in holiday_table(years).collect()}
    for d in ["2024-01-01", "2024-01-15", "2024-02-19", "2024-05-27", "2024-06-19", "2024-07-04",
              "2024-09-02", "2024-10-14", "2024-11-11", "2024-11-28", "2024-12-25"]:
        assert dt.date.fromisoformat(d) in got, d
    assert dt.date(2021, 12, 31) in got   # New Year 2022 falls on a Saturday
    assert dt.date(2022, 12, 26) in got   # Christmas 2022 falls on a Sunday
    assert dt.date(2021, 6, 18) in got    # Juneteenth 2021 (Saturday) observed Friday
    assert dt.date(2024, 3, 1) not in got


def test_flags_and_null_timestamp(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 7, 5, 8),), (None,)], "datetime timestamp_ntz")
    out = with_is_holiday(df).withColumns(calendar_columns("datetime")).collect()
    a, b = out
    assert a["is_rush_hour_am"] == 1 and a["is_friday"] == 1 and a["is_summer"] == 1
    assert a["is_day4_hour8"] == 1 and a["is_holiday"] == 0 and a["is_business_hours"] == 0
    assert b["hour_of_day"] is None and b["is_night"] == 0 and b["is_holiday"] == 0
