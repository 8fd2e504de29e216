"""Registered model queries (Spark ML). The ``model_ols_*`` queries run the whole
model path — scaling, sequences, split, fit, routing, scoring, saving — with a
least-squares model of one lag, which SQL can restate (``regr_slope``). The
others depend on trained trees or penalised fits and have no SQL oracle;
``tests/test_model.py`` checks them against hand-computed expectations.

Fitted forecasters are memoised per (session, table folder, config) so that
queries sharing a model do not retrain it.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.operators.features import FeatureState
from hourcast.operators.scaling import fit_scalers, serve, series_statistics, serving_table
from hourcast.operators.sequences import sequence_columns, windows_before
from hourcast.operators.windows import add_row_index, halo_window
from hourcast.plans.ingest import driver_forecast
from hourcast.plans.model import (PRESETS, Forecaster, ModelConfig, MultiStepForecaster,
                                  run_experiments)
from hourcast.plans.queries import SERIES, enriched_table, features, hourly_table, memo_key, presented
from hourcast.session import checkpoint_dir

_FITTED: dict = {}


def _fitted(spark: SparkSession, sf: str, cfg: ModelConfig, cls=Forecaster):
    key = (memo_key(spark, sf), repr(cfg), cls.__name__)
    if key not in _FITTED:
        m = cls(cfg)
        m.fit(enriched_table(spark, sf, cfg.series_cols),
              features=features(spark, sf, cfg.spec, cfg.series_cols))
        _FITTED[key] = m
    return _FITTED[key]


def q_model_single(spark: SparkSession, sf: str) -> DataFrame:
    """GBT on 12-hour sequences, 2 hours ahead: test metrics (ML-4, ML-12, AG-14..16)."""
    return presented(_fitted(spark, sf, ModelConfig()).result.metrics)


def q_model_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Weekday / weekend ensemble: per-member and pooled metrics (ML-9, AG-18)."""
    return presented(_fitted(spark, sf, ModelConfig(ensemble=True)).result.metrics)


def q_model_linear_l1(spark: SparkSession, sf: str) -> DataFrame:
    """Elastic-net linear model with the l1 penalty mapping (ML-5, ML-6)."""
    cfg = ModelConfig(algorithm="linear", reg_type="l1", reg_value=0.0005)
    return presented(_fitted(spark, sf, cfg).result.metrics)


def q_model_test_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Actual vs predicted on the test split with residuals (ML-12, AN-6)."""
    f = _fitted(spark, sf, ModelConfig())
    p = f.result.test_predictions
    return presented(p.withColumns({"residual": F.col("actual") - F.col("predicted"),
                                    "abs_error": F.abs(F.col("actual") - F.col("predicted"))}).drop("_rn"))


def q_model_predict_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast from the newest 12 hours, routed by day type (ML-10, ML-11)."""
    f = _fitted(spark, sf, ModelConfig(ensemble=True))
    return presented(f.predict(enriched_table(spark, sf)))


def q_model_multistep(spark: SparkSession, sf: str) -> DataFrame:
    """Direct 1…6-hour models: metrics per step (ML-13, AG-17)."""
    cfg = ModelConfig(seq_length=8, horizon=6, algorithm="linear", reg_type="l2")
    return presented(_fitted(spark, sf, cfg, MultiStepForecaster).metrics)


def q_model_predict_ahead(spark: SparkSession, sf: str) -> DataFrame:
    """Next 1…6 hours after the newest row (ML-14)."""
    cfg = ModelConfig(seq_length=8, horizon=6, algorithm="linear", reg_type="l2")
    ms = _fitted(spark, sf, cfg, MultiStepForecaster)
    return presented(ms.predict_ahead(enriched_table(spark, sf), 6))


def q_model_multistep_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Actual vs predicted per step on the test split (AN-6, multi-step)."""
    cfg = ModelConfig(seq_length=8, horizon=6, algorithm="linear", reg_type="l2")
    ms = _fitted(spark, sf, cfg, MultiStepForecaster)
    p = ms.test_predictions
    return presented(p.withColumn("residual", F.col("actual") - F.col("predicted")))


def q_model_permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Permutation importance on the training sequences (AN-1, AN-2)."""
    f = _fitted(spark, sf, ModelConfig())
    return presented(f.permutation_importance())


def q_model_forecast_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """History ∪ forecast rows scored hour by hour (ML-15, ST-2, WN-9).

    History ends ten days before the newest hour; the model sees nothing after it,
    and the forecast rows are the derived 3-hourly forecast from there on."""
    whole = enriched_table(spark, sf)
    newest = whole.agg(F.max("datetime")).first()[0]
    cut = newest - timedelta(days=10) if newest is not None else datetime(2000, 1, 1)
    hist = whole.where(F.col("datetime") <= F.lit(cut).cast("timestamp_ntz"))
    f = Forecaster(ModelConfig())
    f.fit(hist)
    return presented(f.score_forecast(hist, driver_forecast(spark, sf, f"{cut:%Y-%m-%d %H:%M:%S}", 240)))


# ------------------------------------------------- least squares on one lag

def _one_lag(spark: SparkSession, sf: str):
    """The hourly series with one feature, the count itself: (table, state)."""
    hourly = hourly_table(spark, sf).select("datetime", "trip_count", "is_weekend", F.col("trip_count").cast("double").alias("level"))
    return add_row_index(hourly, "datetime"), FeatureState("base", [], feature_names=["level"])


OLS = ModelConfig(spec="base", algorithm="linear", seq_length=1, horizon=2)


def _ols(spark: SparkSession, sf: str, **overrides) -> Forecaster:
    f = Forecaster(OLS, **overrides)
    f.fit(hourly_table(spark, sf), features=_one_lag(spark, sf))
    return f


def q_model_ols_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Test predictions of the single model (ML-3, ML-4, ML-12, FN-NU7)."""
    return presented(_ols(spark, sf).result.test_predictions.drop("_rn"))


def q_model_ols_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Test metrics of the single model (ML-12, AG-14..16)."""
    return presented(_ols(spark, sf).result.metrics)


def q_model_ols_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Test predictions of the weekday / weekend members (ML-9, ML-10, FLT-1)."""
    return presented(_ols(spark, sf, ensemble=True).result.test_predictions.drop("_rn"))


def q_model_ols_next(spark: SparkSession, sf: str) -> DataFrame:
    """Test predictions with the next row as target (WN-7)."""
    return presented(_ols(spark, sf, mode="next").result.test_predictions.drop("_rn"))


def q_model_ols_multistep(spark: SparkSession, sf: str) -> DataFrame:
    """Test predictions of the direct models for steps 1…6 (ML-13)."""
    m = MultiStepForecaster(OLS, horizon=6)
    m.fit(hourly_table(spark, sf), features=_one_lag(spark, sf))
    return presented(m.test_predictions)


def q_model_ols_saved(spark: SparkSession, sf: str) -> DataFrame:
    """Ensemble saved, loaded, and scoring every sequence of the series (SNK-4, SRC-8, ST-3)."""
    f = _ols(spark, sf, ensemble=True)
    path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    f.save(path)
    g = Forecaster.load(path)
    seqs = f.result.train_samples.select("datetime", "target_time", "_rn", "seq", "features")
    return presented(g._route_and_score(seqs).drop("_rn"))


# --------------------------------------------- two features over five series

def _two_features(spark: SparkSession, sf: str):
    """The hourly series of every event type with two features, the count and its hour: (table, state)."""
    hourly = hourly_table(spark, sf, SERIES).select(*SERIES, "datetime", "trip_count", "is_weekend", F.col("trip_count").cast("double").alias("level"),
                                                    F.col("hour").cast("double").alias("clock"))
    return add_row_index(hourly, "datetime", SERIES), FeatureState("base", SERIES, feature_names=["level", "clock"])


RIDGE = ModelConfig(spec="base", algorithm="ridge", seq_length=1, horizon=2, series_cols=tuple(SERIES))
#: name: (penalty, strength); small and large ones of every kind
PENALTIES = {"none": (None, 0.0), "l2_small": ("l2", 0.001), "l2_large": ("l2", 0.5), "l1_small": ("l1", 0.0005), "l1_large": ("l1", 0.05), "l1_l2": ("l1_l2", 0.01)}


def q_scaler_params_series(spark: SparkSession, sf: str) -> DataFrame:
    """Medians, quartiles and ranges of every series (AG-12, ML-1, ML-2 per series)."""
    rows = _two_features(spark, sf)[0]
    return presented(series_statistics(rows, ["level", "clock"], "trip_count", SERIES).drop("k"))


def q_model_importance_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Permutation importance of a least-squares model over all series (AN-1)."""
    f = Forecaster(RIDGE)
    f.fit(hourly_table(spark, sf, SERIES), features=_two_features(spark, sf))
    return presented(f.permutation_importance())


def q_model_ridge_multistep(spark: SparkSession, sf: str) -> DataFrame:
    """Test predictions of the ridge models of steps 1…6 over all series, from one pass (ML-5, ML-6, ML-13)."""
    m = MultiStepForecaster(RIDGE, horizon=6, reg_type="l2", reg_value=0.1)
    m.fit(hourly_table(spark, sf, SERIES), features=_two_features(spark, sf))
    return presented(m.test_predictions)


def q_model_penalty_path(spark: SparkSession, sf: str) -> DataFrame:
    """Test metrics of six penalties at steps 1…6, all from one pass (ML-6, ML-16)."""
    m = MultiStepForecaster(RIDGE, horizon=6)
    feats, _ = _two_features(spark, sf)
    return presented(m.fit_penalties(hourly_table(spark, sf, SERIES), PENALTIES, (feats, FeatureState("base", SERIES, feature_names=["level"]))))


def q_model_ols_routed(spark: SparkSession, sf: str) -> DataFrame:
    """Ensemble of the next-row variant, every training sequence scored by the member of its last row's day (ML-10)."""
    f = _ols(spark, sf, ensemble=True, mode="next")
    return presented(f._route_and_score(f.result.train_samples.drop("target")).drop("_rn"))


def q_forecast_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of 12 rows before every forecast hour of every series, history and earlier forecast rows in
    them (ST-2, WN-9). History ends five days before the newest hour; the forecast holds for all series."""
    hourly = hourly_table(spark, sf, SERIES).select(*SERIES, "datetime", F.col("trip_count").cast("double").alias("level"))
    ends = hourly.agg(F.max("datetime")).first()[0]
    cut = F.lit(ends - timedelta(days=5) if ends is not None else datetime(2000, 1, 1)).cast("timestamp_ntz")
    history = hourly.where(F.col("datetime") <= cut)
    forecast = driver_forecast(spark, sf).select("datetime", F.col("temp").alias("level"))
    f = Forecaster(RIDGE)
    ahead = f.forecast_rows(history, forecast)
    rows = add_row_index(history.withColumn("told", F.lit(0)).unionByName(ahead.withColumn("told", F.lit(1)), allowMissingColumns=True), "datetime", SERIES)
    out = windows_before(rows, ["level"], 12, SERIES, keep=["datetime", "told"]).where("told = 1")
    return presented(sequence_columns(out.select(*SERIES, "datetime", "seq"), 12))


def q_serving_features(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs of two model versions from one stored table (ML-11, PRJ-8): the rows lack ``day``, which version ``a``
    was trained on, bring ``clock``, which it was not, and have a null ``before`` in each series' first row."""
    rows, _ = _two_features(spark, sf)
    rows = halo_window(rows, SERIES, lambda w: {"before": F.lag("level").over(w)}, back=1).withColumn("day", F.dayofmonth("datetime"))
    table = serving_table(spark, {"a": fit_scalers(rows, ["level", "before", "day"], "trip_count"), "b": fit_scalers(rows, ["clock", "before"], "trip_count")})
    asked = rows.drop("day", "is_weekend", "trip_count", "_rn").withColumn("model_version", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("unknown"))))
    out = serve(asked, table, [*SERIES, "datetime"])
    return presented(out.select("model_version", *SERIES, "datetime", F.posexplode("features").alias("position", "value")))


def q_model_experiments(spark: SparkSession, sf: str) -> DataFrame:
    """The named parameter sets, one metrics row each (ML-16)."""
    return presented(run_experiments(enriched_table(spark, sf), PRESETS, ModelConfig(algorithm="linear"),
                                     features=features(spark, sf, "h2")))


def q_model_save_load(spark: SparkSession, sf: str) -> DataFrame:
    """Save an ensemble to the shared checkpoint folder, load it, score (SNK-4, SRC-8)."""
    f = _fitted(spark, sf, ModelConfig(ensemble=True))
    path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    f.save(path)
    g = Forecaster.load(path)
    return presented(g.predict(enriched_table(spark, sf)))


def q_model_base_next(spark: SparkSession, sf: str) -> DataFrame:
    """The base variant: 8-hour sequences, next-row target (WN-7), base feature set."""
    cfg = ModelConfig(spec="base", mode="next", seq_length=8)
    return presented(_fitted(spark, sf, cfg).result.metrics)


def q_model_h24(spark: SparkSession, sf: str) -> DataFrame:
    """The 24-hour variant: 24-hour sequences, target 24 rows ahead, h24 features."""
    cfg = ModelConfig(spec="h24", seq_length=24, horizon=24, algorithm="linear", reg_type="l2")
    return presented(_fitted(spark, sf, cfg).result.metrics)


def q_model_per_series(spark: SparkSession, sf: str) -> DataFrame:
    """One pooled model over five series (event types); the latest forecast of
    every series is scored in one job (ML-11 per series)."""
    series = ("rideable_type",)
    cfg = ModelConfig(algorithm="linear", reg_type="l2", series_cols=series)
    f = _fitted(spark, sf, cfg)
    return presented(f.predict(enriched_table(spark, sf, series)))


MODEL_REGISTRY = {
    "scaler_params_series": q_scaler_params_series,
    "model_importance_linear": q_model_importance_linear,
    "model_ridge_multistep": q_model_ridge_multistep,
    "model_penalty_path": q_model_penalty_path,
    "model_ols_routed": q_model_ols_routed,
    "forecast_windows": q_forecast_windows,
    "serving_features": q_serving_features,
    "model_ols_predictions": q_model_ols_predictions,
    "model_ols_metrics": q_model_ols_metrics,
    "model_ols_ensemble": q_model_ols_ensemble,
    "model_ols_next": q_model_ols_next,
    "model_ols_multistep": q_model_ols_multistep,
    "model_ols_saved": q_model_ols_saved,
    "model_per_series": q_model_per_series,
    "model_base_next": q_model_base_next,
    "model_h24": q_model_h24,
    "model_single": q_model_single,
    "model_ensemble": q_model_ensemble,
    "model_linear_l1": q_model_linear_l1,
    "model_test_predictions": q_model_test_predictions,
    "model_predict_latest": q_model_predict_latest,
    "model_multistep": q_model_multistep,
    "model_predict_ahead": q_model_predict_ahead,
    "model_multistep_predictions": q_model_multistep_predictions,
    "model_permutation_importance": q_model_permutation_importance,
    "model_forecast_scoring": q_model_forecast_scoring,
    "model_experiments": q_model_experiments,
    "model_save_load": q_model_save_load,
}
