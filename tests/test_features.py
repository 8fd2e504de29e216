import numpy as np
import pandas as pd

from hourcast.operators.features import SPECS, preprocess
from hourcast.operators.windows import RN


def test_preprocess_columns_and_no_nulls(spark, hourly_fixture):
    df = spark.createDataFrame(hourly_fixture)
    feats, st = preprocess(df, "h2")
    cols = set(feats.columns)
    for c in ["hour_of_day", "is_weekday", "is_weekend", "trip_count_lag_1", "trip_count_ma_3h",
              "weather_Clear", "weather_Clouds", "weather_Rain", "is_holiday", "is_day6_hour20",
              "temp_weekend_interaction", "rain_rush_hour_interaction", "hour_sin", "day_of_week_cos"]:
        assert c in cols, c
    assert "weather_main" not in cols and "date" not in cols
    pdf = feats.drop(RN).toPandas()
    assert pdf.isna().sum().sum() == 0
    assert st.weather_categories == ["Clear", "Clouds", "Rain"]
    assert len(st.feature_names) == len(cols) - 3  # datetime, _rn, trip_count


def test_lags_and_median_fill_match_pandas(spark, hourly_fixture):
    pdf = hourly_fixture.copy()
    pdf.loc[5, "temp"] = np.nan
    pdf.loc[7, "temp"] = np.inf
    feats, st = preprocess(spark.createDataFrame(pdf), "h2")
    got = feats.toPandas().sort_values("datetime").reset_index(drop=True)
    ref = pdf.replace([np.inf, -np.inf], np.nan)
    med_temp = ref["temp"].median()
    assert abs(got.loc[5, "temp"] - med_temp) < 1e-12 and abs(got.loc[7, "temp"] - med_temp) < 1e-12
    y = ref["trip_count"].astype(float)
    lag24 = y.shift(24)
    exp = lag24.fillna(lag24.median())
    np.testing.assert_allclose(got["trip_count_lag_24"], exp)
    std6 = y.rolling(6).std()
    np.testing.assert_allclose(got["trip_count_std_6h"], std6.fillna(std6.median()))
    np.testing.assert_allclose(got["trip_count_diff_3"], y.diff(3).fillna(y.diff(3).median()))


def test_training_categories_at_serving(spark, hourly_fixture):
    feats, st = preprocess(spark.createDataFrame(hourly_fixture), "h2")
    new = hourly_fixture.head(30).copy()
    new["weather_main"] = ["Snow"] * 10 + [None] * 10 + ["Rain"] * 10   # unseen and null categories
    f2, _ = preprocess(spark.createDataFrame(new), "h2", state=st)
    pdf = f2.toPandas().sort_values("datetime")
    assert "weather_Snow" not in pdf.columns
    assert pdf[["weather_Clear", "weather_Clouds", "weather_Rain"]].iloc[:10].sum().sum() == 0
    assert (pdf["weather_Rain"].iloc[20:] == 1).all()
    assert pdf.isna().sum().sum() == 0


def test_all_null_column_pass_one_zero(spark, hourly_fixture):
    pdf = hourly_fixture.copy()
    pdf["snow_1h"] = np.nan
    feats, st = preprocess(spark.createDataFrame(pdf), "base")
    assert "snow_1h" in st.zero_cols
    assert feats.where("snow_1h != 0").count() == 0
    assert SPECS["base"].day_hour_flags is False and "is_day0_hour8" not in feats.columns
