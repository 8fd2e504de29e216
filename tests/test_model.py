import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from hourcast.plans.model import Forecaster, ModelConfig, MultiStepForecaster, elastic_net, run_experiments


def _history(spark, hourly_fixture, days=14):
    import numpy as np

    n = 24 * days
    rng = np.random.default_rng(11)
    t = pd.date_range("2023-01-02", periods=n, freq="h")
    base = 50 + 30 * np.sin(2 * np.pi * t.hour / 24) + 15 * (t.dayofweek < 5)
    pdf = pd.DataFrame({"datetime": t, "trip_count": (base + rng.normal(0, 3, n)).round().astype("int64"),
                        "temp": rng.uniform(0, 30, n), "rain_1h": 0.0,
                        "weather_main": rng.choice(["Clear", "Clouds"], n)})
    return spark.createDataFrame(pdf)


def test_elastic_net_mapping():
    assert elastic_net("l2", 0.01) == (0.01, 0.0)
    assert elastic_net("l1", 0.01) == (0.005, 1.0)
    lam, a = elastic_net("l1_l2", 0.01)
    assert abs(lam - 0.015) < 1e-12 and abs(a - 1 / 3) < 1e-12


def test_linear_fit_predict_save_load(spark, hourly_fixture):
    hist = _history(spark, hourly_fixture)
    f = Forecaster(ModelConfig(algorithm="linear", seq_length=6, spec="base", ensemble=True))
    res = f.fit(hist)
    m = {r["member"]: r for r in res.metrics.collect()}
    assert set(m) == {"weekday", "weekend", "all"}
    assert m["all"]["n"] == m["weekday"]["n"] + m["weekend"]["n"]
    assert m["all"]["r2"] > 0.5  # daily cycle is learnable
    p = f.predict(hist).collect()
    last = hist.agg(F.max("datetime")).first()[0]
    target = last + pd.Timedelta(hours=2)
    assert len(p) == 1 and p[0]["last_time"] == last and p[0]["target_time"] == target
    assert p[0]["member"] == ("weekend" if target.weekday() >= 5 else "weekday")
    # a history ending on a Saturday evening routes to the weekend member
    sat = hist.where(F.col("datetime") <= F.lit("2023-01-14 20:00:00").cast("timestamp_ntz"))
    assert f.predict(sat).first()["member"] == "weekend"
    d = os.path.join(tempfile.mkdtemp(), "m")
    f.save(d)
    g = Forecaster.load(d)
    q = g.predict(hist).collect()
    assert abs(q[0]["predicted_trips"] - p[0]["predicted_trips"]) < 1e-9


def test_short_data_falls_back_to_single(spark, hourly_fixture):
    hist = _history(spark, hourly_fixture, days=4)  # < 10·L weekend rows
    f = Forecaster(ModelConfig(algorithm="linear", seq_length=12, spec="base", ensemble=True))
    res = f.fit(hist)
    assert set(f.models) == {"all"} and res.metrics.count() == 1


def test_gbt_importance_and_multistep(spark, hourly_fixture):
    hist = _history(spark, hourly_fixture, days=8)
    f = Forecaster(ModelConfig(seq_length=4, spec="base", max_iter=5, max_depth=3))
    f.fit(hist)
    imp = f.permutation_importance().toPandas()
    assert set(imp["member"]) == {"all"} and len(imp) == len(f.state.feature_names) and (imp["importance"] >= 0).all()
    # a feature no tree splits on (at any of its L positions) cannot move a prediction
    names, L = f.state.feature_names, f.cfg.seq_length
    fi = f.models["all"].featureImportances.toArray()
    used = {n for j, n in enumerate(names) if any(fi[t * len(names) + j] > 0 for t in range(L))}
    by_name = dict(zip(imp["feature"], imp["importance"]))
    assert all(by_name[n] == 0.0 for n in names if n not in used)
    assert any(by_name[n] > 0.0 for n in used)
    ms = MultiStepForecaster(ModelConfig(seq_length=4, horizon=3, spec="base", algorithm="linear"))
    met = ms.fit(hist).orderBy("hours_ahead").collect()
    assert [r["hours_ahead"] for r in met] == [1, 2, 3]
    ahead = ms.predict_ahead(hist, 5).orderBy("hours_ahead").collect()
    assert [r["hours_ahead"] for r in ahead] == [1, 2, 3]  # capped at H


def test_not_enough_rows_for_scoring(spark, hourly_fixture):
    import pytest

    hist = _history(spark, hourly_fixture, days=6)
    f = Forecaster(ModelConfig(algorithm="linear", seq_length=6, spec="base"))
    f.fit(hist)
    with pytest.raises(ValueError):
        f.predict(hist.orderBy("datetime").limit(3))


def test_complete_pipeline(spark, hourly_fixture):
    from hourcast.plans.model import run_complete_pipeline

    hist = _history(spark, hourly_fixture, days=14)
    out = run_complete_pipeline(hist, base_seq_length=4, algorithm="linear")
    assert set(out) == {"base_metrics", "ensemble_metrics", "multistep_metrics", "forecast_ahead",
                        "importance", "categories", "correlations", "unexpected"}
    assert out["categories"].count() == 4 and out["correlations"].count() == 16 * 16
    assert out["base_metrics"].first()["n"] > 0
    assert out["multistep_metrics"].count() == 6 and out["forecast_ahead"].count() == 6


def test_unsupported_settings_are_refused():
    import pytest

    for bad in ({"algorithm": "linear", "loss": "mae"}, {"loss": "huber"}, {"loss": "smape"}, {"reg_type": "l2"},
                {"algorithm": "forest"}, {"algorithm": "linear", "loss": "huber", "reg_type": "l1"},
                {"algorithm": "linear", "reg_type": "l3"}):
        with pytest.raises(ValueError):
            Forecaster(ModelConfig(), **bad)
    assert Forecaster(ModelConfig(algorithm="linear", reg_type="l1_l2")).cfg.reg_type == "l1_l2"


def _two_series(spark, hourly_fixture, days=10):
    hist = _history(spark, hourly_fixture, days)
    return (hist.withColumn("line", F.lit("a"))
            .unionByName(hist.withColumn("line", F.lit("b")).withColumn("trip_count", F.col("trip_count") * 2))
            .where("not (line = 'b' and datetime >= timestamp_ntz'2023-01-11 21:00:00')"))


def test_forecast_scoring_per_series(spark, hourly_fixture):
    """Every forecast hour after a series' own newest row, from the window before it."""
    hist = _two_series(spark, hourly_fixture)
    f = Forecaster(ModelConfig(algorithm="linear", spec="base", seq_length=4, series_cols=("line",)))
    f.fit(hist)
    last = pd.Timestamp("2023-01-11 23:00:00")
    fc = spark.createDataFrame(pd.DataFrame({"datetime": [last + pd.Timedelta(hours=h) for h in range(-1, 7)], "temp": 10.0,
                                             "rain_1h": 0.0, "weather_main": "Clear"}))
    got = f.score_forecast(hist, fc).toPandas()
    a, b = got[got.line == "a"], got[got.line == "b"]
    assert len(a) == 6 and len(b) == 8 and got.predicted_trips.notna().all()
    assert (got.target_time == got.datetime).all() and a.datetime.min() == last + pd.Timedelta(hours=1)
    # the first forecast hour needs history only: it is the window that ends at the newest row
    first = f.forecast_sequences(hist, fc).where("line = 'a'").orderBy("datetime").first()["seq"]
    newest = f.latest_sequences(hist).where("line = 'a'").first()["seq"]
    assert all(abs(x - y) < 1e-9 for x, y in zip(first, newest))


def test_importance_samples_are_unique_per_series(spark, hourly_fixture):
    hist = _two_series(spark, hourly_fixture)
    f = Forecaster(ModelConfig(algorithm="linear", spec="base", seq_length=3, series_cols=("line",), ensemble=True))
    f.fit(hist)
    train = f.result.train_samples
    ids = train.select("member", F.xxhash64("line", "_rn").alias("i"))
    assert ids.distinct().count() == ids.count() == train.count()
    imp = f.permutation_importance().toPandas()
    assert imp.groupby("member").size().to_dict() == {m: len(f.state.feature_names) for m in ("weekday", "weekend")}
    assert f.permutation_importance(n_top=2).groupBy("member").count().where("count = 2").count() == 2


def test_serving_uses_the_training_medians(spark, hourly_fixture):
    """A null that training never saw is filled with the stored median; an absent feature counts as raw 0."""
    hist = _history(spark, hourly_fixture, 8)
    f = Forecaster(ModelConfig(algorithm="linear", spec="base", seq_length=3))
    f.fit(hist)
    holes = hist.withColumn("temp", F.lit(None).cast("double"))
    filled = hist.withColumn("temp", F.lit(float(f.state.medians_pre["temp"])))
    a, b = (f.predict(x).first()["predicted_trips"] for x in (holes, filled))
    assert abs(a - b) < 1e-9
    assert len(f.state.medians_post) >= len(f.state.feature_names)


def test_scalers_see_training_rows_only(spark, hourly_fixture):
    hist = _history(spark, hourly_fixture, 10)
    late = hist.withColumn("temp", F.when(F.col("datetime") > F.lit("2023-01-10").cast("timestamp_ntz"), 1e6).otherwise(F.col("temp")))
    f, g = (Forecaster(ModelConfig(algorithm="linear", spec="base", seq_length=3)) for _ in range(2))
    f.fit(hist)
    g.fit(late)
    assert f.scalers.median["temp"] == g.scalers.median["temp"]


def test_multistep_save_load(spark, hourly_fixture):
    hist = _history(spark, hourly_fixture, 8)
    f = MultiStepForecaster(ModelConfig(seq_length=4, horizon=2, spec="base", algorithm="linear"))
    f.fit(hist)
    d = os.path.join(tempfile.mkdtemp(), "m")
    f.save(d)
    want = [tuple(r) for r in f.predict_ahead(hist).orderBy("hours_ahead").collect()]
    assert [tuple(r) for r in MultiStepForecaster.load(d).predict_ahead(hist).orderBy("hours_ahead").collect()] == want


def test_routing_fallbacks(spark):
    import pytest
    from hourcast.plans.model import route_member

    days = spark.range(7).select(F.col("id").cast("int").alias("day_of_week"))
    got = [r[0] for r in days.orderBy("day_of_week").select(route_member(days)).collect()]
    assert got == ["weekday"] * 5 + ["weekend"] * 2
    got = [r[0] for r in days.orderBy("day_of_week").select(route_member(days, 24)).collect()]
    assert got == ["weekday"] * 4 + ["weekend"] * 2 + ["weekday"]
    flags = spark.createDataFrame([(0,), (1,)], "is_weekend int")
    assert [r[0] for r in flags.select(route_member(flags)).collect()] == ["weekday", "weekend"]
    with pytest.raises(ValueError):
        route_member(spark.range(1))
