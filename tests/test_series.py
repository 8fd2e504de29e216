"""Statistics, scalers and linear models over several series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from hourcast.operators import gram
from hourcast.operators.features import preprocess
from hourcast.operators.importance import linear_importance
from hourcast.operators.scaling import fit_scalers, fit_series_scalers, transform
from hourcast.plans.model import Forecaster, ModelConfig, MultiStepForecaster


def history(spark, series=("small", "large"), days=9):
    parts = []
    for i, name in enumerate(series):
        rng = np.random.default_rng(20 + i)
        t = pd.date_range("2023-01-02", periods=24 * days, freq="h")
        base = (50 + 30 * np.sin(2 * np.pi * t.hour / 24)) * (1 if i == 0 else 200)
        parts.append(pd.DataFrame({"line": name, "datetime": t, "trip_count": (base + rng.normal(0, 3, len(t))).round().astype("int64"),
                                   "temp": rng.uniform(0, 30, len(t)) + 100 * i, "rain_1h": 0.0, "weather_main": rng.choice(["Clear", "Clouds"], len(t))}))
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


def test_scalers_of_each_series_are_its_own(spark):
    df = history(spark).withColumn("temp", F.when(F.hour("datetime") != 3, F.col("temp")))
    both = fit_series_scalers(df, ["temp", "rain_1h"], "trip_count", ["line"])
    rows = {(r["line"], r["datetime"]): r for r in transform(df, both, keep=["line", "datetime"], target_out="y").collect()}
    for name in ("small", "large"):
        alone = df.where(F.col("line") == name)
        one = transform(alone, fit_scalers(alone, ["temp", "rain_1h"], "trip_count"), keep=["line", "datetime"], target_out="y").collect()
        assert len(one) == 216
        for r in one:
            told = rows[(name, r["datetime"])]
            np.testing.assert_allclose([told["temp"], told["rain_1h"], told["y"]], [r["temp"], r["rain_1h"], r["y"]], atol=1e-12)
    strange = transform(df.withColumn("line", F.lit("new")), both, keep=["line"], target_out="y").first()
    assert strange["temp"] == 0.0 and strange["_low"] == 0.0 and strange["_range"] == 1.0


def test_imputation_of_each_series_is_its_own(spark):
    df = history(spark, days=4).withColumn("temp", F.when(F.hour("datetime") % 5 != 0, F.col("temp")))
    df = df.withColumn("clouds", F.when((F.col("line") == "small") & (F.hour("datetime") < 9), F.hour("datetime").cast("double")))
    out, state = preprocess(df, "base", ["line"])
    got = {(r["line"], r["datetime"]): r for r in out.collect()}
    for name in ("small", "large"):
        alone, _ = preprocess(df.where(F.col("line") == name), "base")
        for r in alone.collect():
            told = got[(name, r["datetime"])].asDict()
            for c, v in r.asDict().items():
                if c not in ("datetime", "_rn") and not c.startswith("weather_"):
                    assert told[c] == pytest.approx(v, nan_ok=True), (name, c)
    # serving: a column without nulls when fitted, and a series that was not
    late = df.where("datetime >= '2023-01-05'").withColumn("rain_1h", F.lit(None).cast("double")).withColumn(
        "line", F.when(F.hour("datetime") < 12, F.col("line")).otherwise("new"))
    served, _ = preprocess(late, "base", ["line"], state=state)
    assert served.where("rain_1h is null or temp is null").count() == 0
    assert {r["temp"] for r in served.where("line = 'new' and hour_of_day % 5 = 0").collect()} == {0.0}


def sequences(spark, n=400, d=4, h=3):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, d)) * [1, 2, 0.5, 1]
    y = x @ rng.normal(size=(d, h)) + 0.3 * rng.normal(size=(n, h)) + 5
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "i long, seq array<double>, targets array<double>")
    return df.repartition(3), x, y


@pytest.mark.parametrize("reg,alpha", [(0.0, 0.0), (0.2, 0.0), (0.1, 1.0), (0.3, 0.4)])
def test_gram_models_are_those_of_spark(spark, reg, alpha):
    df, x, y = sequences(spark)
    model = gram.solve(gram.gram_of(df, "seq", "targets"), reg, alpha)
    for h in range(3):
        rows = df.select(array_to_vector("seq").alias("features"), F.col("targets")[h].alias("label"))
        # Spark weighs the squared part by the label's deviation: the same penalty in its terms
        l1, l2 = reg * alpha, reg * (1 - alpha) * y[:, h].std()
        want = LinearRegression(regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2) if reg else 0.0, standardization=False, tol=1e-12, maxIter=500).fit(rows)
        np.testing.assert_allclose(model.weights[h], want.coefficients.toArray(), atol=1e-5)
        assert model.intercepts[h] == pytest.approx(want.intercept, abs=1e-5)
    got = np.array([r["p"] for r in df.orderBy("i").select(model.predictions("seq").alias("p")).collect()])
    np.testing.assert_allclose(got, x @ model.weights.T + model.intercepts, atol=1e-9)


def test_gram_adds_up_and_survives_dependent_columns(spark):
    df, x, y = sequences(spark)
    half = gram.gram_of(df.where("i < 150"), "seq", "targets") + gram.gram_of(df.where("i >= 150"), "seq", "targets")
    whole = gram.gram_of(df, "seq", "targets")
    np.testing.assert_allclose(half.matrix, whole.matrix, atol=1e-9)
    assert whole.n == 400 and gram.gram_of(df.limit(0), "seq", "targets") is None
    twice = df.withColumn("seq", F.concat("seq", F.array(F.col("seq")[0], F.lit(1.0))))
    model = gram.solve(gram.gram_of(twice, "seq", "targets"), 0.0)
    plain = gram.solve(whole, 0.0)
    both = np.column_stack([x, x[:, 0], np.ones(len(x))])
    np.testing.assert_allclose(both @ model.weights.T + model.intercepts, x @ plain.weights.T + plain.intercepts, atol=1e-6)
    assert gram.LinearSteps.from_json(model.to_json()).weights.tolist() == model.weights.tolist()


def test_all_steps_come_from_one_job(spark):
    """Six steps: the training sequences are summed once, not once a step."""
    hist = history(spark, days=6)
    m = MultiStepForecaster(ModelConfig(spec="base", algorithm="ridge", reg_type="l2", reg_value=0.1, seq_length=4, horizon=6, series_cols=("line",)))
    calls = []
    keep = gram.gram_of
    gram.gram_of = lambda *a: (calls.append(1), keep(*a))[1]
    try:
        met = m.fit(hist).orderBy("hours_ahead").collect()
    finally:
        gram.gram_of = keep
    assert len(calls) == 1 and [r["hours_ahead"] for r in met] == [1, 2, 3, 4, 5, 6] and all(r["r2"] > 0.8 for r in met)
    plan = m.test_predictions._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan
    ahead = m.predict_ahead(hist, 6).collect()
    assert len(ahead) == 12 and {r["line"] for r in ahead} == {"small", "large"}
    small = [r["predicted_trips"] for r in ahead if r["line"] == "small"]
    assert max(small) < 200 < min(r["predicted_trips"] for r in ahead if r["line"] == "large")


def test_ridge_and_linear_agree_and_are_saved(spark, tmp_path):
    hist = history(spark, days=8)
    kw = dict(spec="base", reg_type="l1", reg_value=0.002, seq_length=3, series_cols=("line",), ensemble=True)
    ridge, linear = Forecaster(ModelConfig(algorithm="ridge", **kw)), Forecaster(ModelConfig(algorithm="linear", max_iter=300, **kw))
    a, b = ridge.fit(hist), linear.fit(hist)
    x = {(r["line"], r["datetime"], r["member"]): r["predicted"] for r in a.test_predictions.collect()}
    y = {(r["line"], r["datetime"], r["member"]): r["predicted"] for r in b.test_predictions.collect()}
    assert x.keys() == y.keys() and len(x) > 20
    for k in x:
        assert x[k] == pytest.approx(y[k], rel=0.02, abs=1.0)
    ridge.save(str(tmp_path / "m"))
    again = Forecaster.load(str(tmp_path / "m"))
    p, q = ({r["line"]: r["predicted_trips"] for r in f.predict(hist).collect()} for f in (ridge, again))
    assert p == pytest.approx(q) and set(p) == {"small", "large"}


def test_penalties_share_the_matrix(spark):
    hist = history(spark, days=6)
    m = MultiStepForecaster(ModelConfig(spec="base", algorithm="ridge", seq_length=2, horizon=3, series_cols=("line",)))
    rows = {(r["penalty"], r["hours_ahead"]): r["mae"] for r in m.fit_penalties(hist, {"a": ("l2", 0.1), "b": ("l1", 0.01)}).collect()}
    assert len(rows) == 6
    for name, (kind, value) in {"a": ("l2", 0.1), "b": ("l1", 0.01)}.items():
        one = MultiStepForecaster(ModelConfig(spec="base", algorithm="ridge", seq_length=2, horizon=3, series_cols=("line",), reg_type=kind, reg_value=value))
        for r in one.fit(hist).collect():
            assert rows[(name, r["hours_ahead"])] == pytest.approx(r["mae"], rel=1e-9)
    with pytest.raises(ValueError):
        MultiStepForecaster(ModelConfig(algorithm="linear", horizon=2)).fit_penalties(hist, {"a": ("l2", 0.1)})


def test_linear_importance_by_hand(spark):
    import hashlib

    rng = np.random.default_rng(6)
    n, L, names = 150, 3, ["a", "b'x"]
    x, w = rng.normal(size=(n, L * 2)), rng.normal(size=L * 2)
    df = spark.createDataFrame([("s" if i % 2 else None, i, v.tolist()) for i, v in enumerate(x)], "line string, i long, seq array<double>").repartition(4)
    got = {r["feature"]: r["importance"] for r in linear_importance(df, "seq", w.tolist(), names, ["line", "i"], seed=7).collect()}
    for f, name in enumerate(names):
        s = x[:, f::2] @ w[f::2]
        order = sorted(range(n), key=lambda i: hashlib.md5(f"7|{name}|{'s' if i % 2 else ''}|{i}".encode()).hexdigest())
        donor = dict(zip(order, [order[-1], *order[:-1]]))
        # the whole slice moves: score the perturbed sequences themselves
        moved = np.array([x[i].copy() for i in range(n)])
        for i in range(n):
            moved[i, f::2] = x[donor[i], f::2]
        assert got[name] == pytest.approx(np.abs(moved @ w - x @ w).mean(), rel=1e-9)
        assert got[name] == pytest.approx(np.mean([abs(s[donor[i]] - s[i]) for i in range(n)]), rel=1e-9)


def hand_loop(losses, patience):
    """Early stopping as an epoch loop: (state kept, epochs run)."""
    best, kept, waited = float("inf"), 0, 0
    for i, loss in enumerate(losses):
        if loss < best:
            best, kept, waited = loss, i, 0
        else:
            waited += 1
            if waited >= patience:
                return kept
    return kept


def test_patience_is_the_hand_run_loop():
    from hourcast.plans.model import patient_step

    rng = np.random.default_rng(2)
    for _ in range(300):
        losses = np.round(rng.normal(size=rng.integers(1, 40)).cumsum() * 0.1 + rng.random(), 1).tolist()
        for patience in (1, 3, 15):
            assert patient_step(losses, patience) == hand_loop(losses, patience)


def test_boosting_stops_by_patience_and_keeps_the_best(spark):
    hist = history(spark, ("small",), days=10)
    cfg = ModelConfig(spec="base", seq_length=3, max_iter=14, max_depth=4, step_size=0.9, patience=3)
    f = Forecaster(cfg)
    f.fit(hist)
    val = f.sequences.where("split = 'val'")
    from hourcast.plans.model import make_estimator

    whole = make_estimator(cfg, False).fit(f.sequences.where("split = 'train'"))
    losses = []
    for n in range(1, 15):  # a model of its own for every number of rounds
        one = make_estimator(ModelConfig(**{**cfg.__dict__, "max_iter": n}), False).fit(f.sequences.where("split = 'train'"))
        losses.append(one.transform(val).select(F.avg((F.col("prediction") - F.col("target")) ** 2)).first()[0])
    kept = hand_loop(losses, 3)
    model = f.models["all"]
    assert model.getNumTrees == kept + 1 < whole.getNumTrees
    got = model.transform(val).select(F.avg((F.col("prediction") - F.col("target")) ** 2)).first()[0]
    assert got == pytest.approx(losses[kept], rel=1e-9)


def test_ridge_stops_by_patience(spark):
    hist = history(spark, ("small",), days=10)
    f = Forecaster(ModelConfig(spec="base", algorithm="ridge", seq_length=3, max_iter=60, patience=4))
    f.fit(hist)
    rows = {s: f.sequences.where(F.col("split") == s) for s in ("train", "val")}
    sums = gram.gram_of(rows["train"], "seq", F.array("target"))
    losses = []
    for state in gram.descent(sums, 0.0, 0.0, 60):
        x = rows["val"].select("target", state.predictions("seq")[0].alias("p"))
        losses.append(x.select(F.avg((F.col("p") - F.col("target")) ** 2)).first()[0] if len(losses) < 12 else state.loss(gram.gram_of(rows["val"], "seq", F.array("target"))))
        if len(losses) == 12:
            held = gram.gram_of(rows["val"], "seq", F.array("target"))
            assert losses == pytest.approx([s.loss(held) for s in gram.descent(sums, 0.0, 0.0, 12)], rel=1e-6)
            break
    held = gram.gram_of(rows["val"], "seq", F.array("target"))
    states = gram.descent(sums, 0.0, 0.0, 60)
    kept = hand_loop([s.loss(held) for s in states], 4)
    assert f.models["all"].weights.tolist() == states[kept].weights.tolist()
    with pytest.raises(ValueError):
        Forecaster(ModelConfig(algorithm="linear", patience=3))


def test_serving_several_versions(spark):
    from hourcast.operators.scaling import Scalers, serve, serving_table

    a = Scalers(["x", "gone", "flat"], "y", {"x": 1.0, "gone": 14.0, "flat": None}, {"x": 0.0, "gone": 12.0, "flat": None}, {"x": 2.0, "gone": 16.0, "flat": None})
    b = Scalers(["extra", "x"], "y", {"extra": 9.0, "x": 3.0}, {"extra": 9.0, "x": 1.0}, {"extra": 9.0, "x": 2.0})
    table = serving_table(spark, {"a": a, "b": b})
    rows = [("a", 1, 3.0, 9), ("a", 2, None, 9), ("b", 3, 5.0, 10), ("b", 4, float("nan"), None), ("c", 5, 1.0, 1), (None, 6, 1.0, 1)]
    df = spark.createDataFrame(rows, "model_version string, id int, x double, extra int")
    got = {r["id"]: (r["model_version"], r["features"]) for r in serve(df, table, ["id"]).collect()}
    assert got == {1: ("a", [1.0, -3.5, 0.0]), 2: ("a", [0.0, -3.5, 0.0]), 3: ("b", [1.0, 2.0]), 4: ("b", [0.0, 0.0])}
    # one row per version, as transform would make it
    one = transform(df.where("id = 1"), a).first()
    assert [one["x"], one["gone"], one["flat"]] == got[1][1]


def test_forecast_meets_days_not_all_pairs(spark):
    f = Forecaster(ModelConfig(spec="base", algorithm="ridge", series_cols=("line",)))
    hist = spark.createDataFrame([("a", "2024-01-01 05:00:00"), ("a", "2024-01-02 23:00:00"), ("b", "2024-01-03 12:00:00"), ("late", "2024-02-01 00:00:00"), ("none", None)],
                                 "line string, t string").select("line", F.col("t").cast("timestamp_ntz").alias("datetime"))
    ahead = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2024-01-02 22:00:00', TIMESTAMP_NTZ'2024-01-04 00:00:00', INTERVAL 1 HOUR)) AS datetime")
    rows = f.forecast_rows(hist, ahead)
    assert "NestedLoop" not in rows._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r["line"], r["datetime"]) for r in rows.collect()}
    last = {"a": pd.Timestamp("2024-01-02 23:00"), "b": pd.Timestamp("2024-01-03 12:00")}
    hours = [r[0] for r in ahead.collect()]
    assert got == {(s, h) for s in last for h in hours if h > last[s]} and len(got) == 25 + 12
    assert f.forecast_rows(hist, ahead.limit(0)).count() == 0


def test_base_variant_goes_by_its_last_row(spark):
    """Sunday 23:00: the next hour is a Monday, but the next-row variant asks the weekend member."""
    hist = history(spark, ("small",), days=20).where("datetime <= '2023-01-15 23:00:00'")
    kw = dict(spec="base", algorithm="ridge", seq_length=3, ensemble=True)
    by_row, by_target = Forecaster(ModelConfig(mode="next", **kw)), Forecaster(ModelConfig(horizon=1, **kw))
    assert {m.predict(hist).first()["member"] for m in (by_row,) if m.fit(hist)} == {"weekend"}
    assert {m.predict(hist).first()["member"] for m in (by_target,) if m.fit(hist)} == {"weekday"}
