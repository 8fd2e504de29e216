"""Sequence forecasting with Spark ML (ML-1..17, FLT-1, FLT-7, ST-2, ST-3, AN-1).

The reference trains a Keras network on (L × F) sequences. Here the same
sequences are built as Spark arrays, flattened into ML vectors and fed to a
distributed regressor (``GBTRegressor`` by default, ``LinearRegression`` with
elastic net as the alternative). Everything around the model — features,
scalers, sequences, the chronological split, ensemble routing, metrics,
importance — is DataFrame code shared with the analytics queries.

Deliberate differences from the reference (documented in the README):
* features are computed once on the continuous series; ensemble members are
  the sequences whose *target* time falls on a weekday / weekend, the same
  rule that routes scoring requests;
* the short-data ensemble fallback really trains the single model;
* serving reuses the training medians, categories and scalers.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark import SparkContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, LinearRegression,
                                   LinearRegressionModel)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourcast.functions.calendar import add_hours
from hourcast.functions.nulls import zero_if_null
from hourcast.functions.sqlexpr import q
from hourcast.operators import analysis, gram
from hourcast.operators import metrics as M
from hourcast.operators import scaling as S
from hourcast.operators.importance import linear_importance
from hourcast.operators.features import SPECS, FeatureState, materialized_features, preprocess
from hourcast.operators.sequences import SEQ, TARGET, TARGETS, build_sequences, chronological_split, windows_before
from hourcast.operators.topk import last_n
from hourcast.operators.windows import RN, add_row_index, halo_window
from hourcast.session import cut_lineage

Y = "_y"          # scaled target
VEC = "features"  # ML vector column
PRED = "prediction"


@dataclass
class ModelConfig:
    spec: str = "h2"
    seq_length: int = 12
    horizon: int = 2
    mode: str = "fixed"          # fixed (target H rows ahead) | next (next row)
    algorithm: str = "gbt"       # gbt | linear | ridge (linear, every step and penalty from one pass)
    loss: str = "mse"            # gbt: mse | mae; linear: mse | huber
    reg_type: str | None = None  # l2 | l1 | l1_l2 | None   (linear and ridge)
    reg_value: float = 0.001
    step_size: float = 0.1       # GBT learning rate
    max_iter: int = 20           # boosting rounds / solver iterations ("epochs")
    max_depth: int = 5
    early_stopping: bool = True  # GBT validation-based stop (patience analogue)
    validation_tol: float = 0.01
    patience: int | None = None  # stop after so many steps without a better validation loss, keep the best
    ensemble: bool = False
    test_size: float = 0.2
    val_size: float = 0.25
    fit_scalers_on: str = "train"  # train (rows up to the last training sequence) | all
    series_cols: tuple[str, ...] = ()
    fill_gaps: bool = False      # dense hour grid before features (lags in hours, not rows)
    seed: int = 42


# Named parameter sets of the experiment runner, reduced to the knobs that keep a
# meaning for Spark ML regressors. Sets that differ only in the optimiser or in a loss that no
# Spark regressor trains (smape, reported as a metric for every run) would be the same model twice.
PRESETS: dict[str, dict] = {
    "default": {"reg_type": "l2", "reg_value": 0.001, "loss": "mse", "max_iter": 20, "ensemble": False},
    "l1": {"reg_type": "l1", "reg_value": 0.0005, "loss": "mse", "max_iter": 20, "ensemble": False},
    "huber": {"reg_type": "l2", "reg_value": 0.001, "loss": "huber", "max_iter": 20, "ensemble": False},
    "ensemble": {"reg_type": "l2", "reg_value": 0.001, "loss": "mse", "max_iter": 20, "ensemble": True},
}

#: What each algorithm can train; anything else is refused, not replaced.
LOSSES = {"linear": ("mse", "huber"), "gbt": ("mse", "mae"), "ridge": ("mse",)}


def checked(cfg: ModelConfig) -> ModelConfig:
    """The configuration, if its algorithm, loss and penalty go together."""
    if cfg.algorithm not in LOSSES:
        raise ValueError(f"algorithm {cfg.algorithm!r} is none of {sorted(LOSSES)}")
    if cfg.loss not in LOSSES[cfg.algorithm]:
        raise ValueError(f"{cfg.algorithm} cannot train loss {cfg.loss!r}; it trains {LOSSES[cfg.algorithm]}")
    if cfg.reg_type not in (None, "l2", "l1", "l1_l2"):
        raise ValueError(f"unknown penalty {cfg.reg_type!r}")
    if cfg.algorithm == "gbt" and cfg.reg_type is not None:
        raise ValueError("gbt takes no weight penalty; set reg_type=None")
    if cfg.patience is not None and cfg.algorithm == "linear":
        raise ValueError("patience goes with gbt and ridge; linear is solved to its end")
    if cfg.loss == "huber" and cfg.reg_type in ("l1", "l1_l2"):
        raise ValueError("the huber loss takes an l2 penalty or none")
    return cfg


def elastic_net(reg_type: str | None, r: float) -> tuple[float, float]:
    """Keras penalty r·Σ|w| / r·Σw² mapped onto Spark's λ(α‖w‖₁ + (1−α)/2‖w‖²)
    with its ½·MSE data term (ML-6)."""
    if reg_type == "l2":
        return r, 0.0
    if reg_type == "l1":
        return r / 2.0, 1.0
    if reg_type == "l1_l2":
        return 1.5 * r, 1.0 / 3.0
    return 0.0, 0.0


def make_estimator(cfg: ModelConfig, with_validation: bool):
    """GBT (default) or linear regressor for the configured loss (ML-4..8)."""
    if cfg.algorithm == "linear":
        reg, alpha = elastic_net(cfg.reg_type, cfg.reg_value)
        kw = dict(featuresCol=VEC, labelCol=TARGET, predictionCol=PRED, maxIter=max(cfg.max_iter, 1),
                  regParam=reg, elasticNetParam=alpha, standardization=False)
        if cfg.loss == "huber":
            kw.update(loss="huber")
        return LinearRegression(**kw)
    kw = dict(featuresCol=VEC, labelCol=TARGET, predictionCol=PRED, maxIter=cfg.max_iter,
              stepSize=cfg.step_size, maxDepth=cfg.max_depth, seed=cfg.seed,
              lossType="absolute" if cfg.loss == "mae" else "squared")
    if with_validation and cfg.early_stopping and cfg.patience is None:
        kw.update(validationIndicatorCol="_is_val", validationTol=cfg.validation_tol)
    return GBTRegressor(**kw)


def patient_step(losses: list[float], patience: int) -> int:
    """The step kept by early stopping (ML-7): the first with the smallest loss before ``patience`` steps have
    passed without a smaller one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The state of a boosted model after its first ``n`` trees."""
    gateway = SparkContext._gateway
    kinds, java = gateway.jvm.org.apache.spark.ml.regression, model._java_obj
    trees, weights = gateway.new_array(kinds.DecisionTreeRegressionModel, n), gateway.new_array(gateway.jvm.double, n)
    every, factors = java.trees(), java.treeWeights()
    for i in range(n):
        trees[i], weights[i] = every[i], factors[i]
    cut = kinds.GBTRegressionModel(java.uid(), trees, weights)
    return GBTRegressionModel(java.copyValues(cut, java.extractParamMap()))


def fitted_model(cfg: ModelConfig, part: DataFrame):
    """A model of the training sequences of ``part``; validation sequences stop it where they can.

    With ``patience`` every step's validation loss is known: boosted stages are evaluated one by one on the
    validation rows, sweeps of the linear descent on their Gram matrix, which is one pass however many sweeps."""
    train, val = part.where(F.col("split") == "train"), part.where(F.col("split") == "val")
    if cfg.algorithm == "ridge":
        sums = gram.gram_of(train, SEQ, F.array(F.col(TARGET)))
        if sums is None:
            raise ValueError("there is no training sequence")
        penalty = elastic_net(cfg.reg_type, cfg.reg_value)
        held = gram.gram_of(val, SEQ, F.array(F.col(TARGET))) if cfg.patience is not None else None
        if held is None:
            return gram.solve(sums, *penalty)
        states = gram.descent(sums, *penalty, sweeps=cfg.max_iter)
        return states[patient_step([s.loss(held) for s in states], cfg.patience)]
    if cfg.algorithm == "gbt" and cfg.patience is not None and not val.isEmpty():
        model = make_estimator(cfg, False).fit(train)
        losses = model.evaluateEachIteration(val, "absolute" if cfg.loss == "mae" else "squared")
        return first_trees(model, patient_step(losses, cfg.patience) + 1)
    use_val = cfg.algorithm == "gbt" and cfg.early_stopping and cfg.patience is None
    return make_estimator(cfg, use_val).fit(part.where(F.col("split").isin("train", "val")) if use_val else train)


def _member_of(target_time: Column) -> Column:
    """Ensemble routing: the day type of the target time (ML-10)."""
    return F.when(F.weekday(target_time) >= 5, F.lit("weekend")).otherwise(F.lit("weekday"))


def route_member(rows: DataFrame, hours: int = 0) -> Column:
    """Ensemble routing of frames that may lack a time (ML-10): by the time ``hours`` ahead, else by
    ``day_of_week`` (one day on when ``hours`` is a whole day), else by ``is_weekend``."""
    have = set(rows.columns)
    if "target_time" in have:
        return _member_of(F.col("target_time"))
    if "datetime" in have:
        return _member_of(add_hours("datetime", hours))
    if "day_of_week" in have:
        weekend = (F.col("day_of_week") + (1 if hours >= 24 else 0)) % 7 >= 5
    elif "is_weekend" in have:
        weekend = F.col("is_weekend") == 1
    else:
        raise ValueError("no time, day_of_week or is_weekend to route by")
    return F.when(weekend, F.lit("weekend")).otherwise(F.lit("weekday"))


@dataclass
class FitResult:
    metrics: DataFrame            # per member + pooled ("all"), or one row
    test_predictions: DataFrame   # (series…, member, target_time, actual, predicted)
    train_samples: DataFrame      # flattened training sequences (for importance)


class Forecaster:
    """Single or weekday/weekend ensemble forecaster H hours ahead."""

    def __init__(self, config: ModelConfig | None = None, **overrides):
        self.cfg = checked(replace(config or ModelConfig(), **overrides))
        self.state: FeatureState | None = None
        self.scalers: S.Scalers | None = None
        self.models: dict[str, object] = {}
        self.result: FitResult | None = None
        self.sequences: DataFrame | None = None  # all labelled sequences of the fit

    # ---------------------------------------------------------------- fitting
    @property
    def series(self) -> list[str]:
        return list(self.cfg.series_cols)

    def _features(self, df: DataFrame, features: tuple | None = None):
        if features is not None:
            return features
        if df.isEmpty():
            raise ValueError("the training table is empty")
        if "trip_count" not in df.columns:
            raise ValueError("the training table has no trip_count")
        return materialized_features(df, self.cfg.spec, self.series, self.cfg.fill_gaps)

    def _sequences(self, scaled: DataFrame, with_target: bool = True) -> DataFrame:
        cfg = self.cfg
        seqs = build_sequences(scaled, self.state.feature_names, Y, cfg.seq_length, cfg.horizon,
                               self.series, mode=cfg.mode, keep=("datetime", S.LOW, S.RANGE))
        h = 1 if cfg.mode == "next" else cfg.horizon
        return seqs.withColumn("target_time", add_hours("datetime", h))

    def ends_of_training(self, feats: DataFrame) -> DataFrame:
        """``(series…, _last)`` of an ensemble: the last row that a training sequence of every member reads. Members
        are split on their own, so the member whose training part ends first decides."""
        cfg, keys = self.cfg, [*self.series, "member"]
        h, after = (1, 1) if cfg.mode == "next" else (cfg.horizon, cfg.horizon + 1)
        n = feats.groupBy(*self.series).agg(F.max(RN).alias("_n"))
        rows = feats.select(*self.series, "datetime", RN, _member_of(add_hours("datetime", h)).alias("member"))
        rows = rows.join(n, self.series) if self.series else rows.withColumn("_n", F.lit(n.first()["_n"]))
        rows = rows.where((F.col(RN) >= cfg.seq_length) & (F.col(RN) <= F.col("_n") - after)).drop("_n")
        split = chronological_split(rows, keys, cfg.test_size, cfg.val_size)
        last = split.where(F.col("split") == "train").groupBy(*keys).agg(F.max(RN).alias("_last"))
        return last.groupBy(*self.series).agg(F.min("_last").alias("_last"))

    def training_rows(self, feats: DataFrame, members: bool = False) -> DataFrame:
        """Rows that training sequences read: scalers see no validation or test row."""
        cfg = self.cfg
        if cfg.fit_scalers_on == "all":
            return feats
        if members:
            bound = self.ends_of_training(feats)
            if self.series:
                return feats.join(bound, self.series).where(F.col(RN) <= F.col("_last")).drop("_last")
            return feats.where(F.col(RN) <= F.lit(bound.first()["_last"]))
        n = feats.groupBy(*self.series).agg(F.max(RN).alias("_n"))
        n_seq = F.greatest(F.col("_n") - cfg.seq_length - cfg.horizon, F.lit(1))
        n_test = F.ceil(n_seq * F.lit(cfg.test_size))
        n_train = n_seq - n_test - F.ceil((n_seq - n_test) * F.lit(cfg.val_size))
        bound = n.select(*self.series, (n_train + cfg.seq_length - 1).alias("_last"))
        if self.series:
            rows = feats.join(bound, self.series)
        else:
            rows = feats.withColumn("_last", F.lit(bound.first()["_last"]))
        return rows.where(F.col(RN) <= F.col("_last")).drop("_last")

    def fit_scalers(self, feats: DataFrame, members: bool = False) -> S.Scalers | S.SeriesScalers:
        """Scalers of the training rows: one set, or one per series where there are series columns."""
        rows = self.training_rows(feats, members)
        if self.series:
            return S.fit_series_scalers(rows, self.state.feature_names, "trip_count", self.series)
        return S.fit_scalers(rows, self.state.feature_names, "trip_count")

    @property
    def carried(self) -> list[str]:
        """Columns that scaled rows bring along besides their keys."""
        return [S.LOW, S.RANGE] if isinstance(self.scalers, S.SeriesScalers) else []

    def fit(self, df: DataFrame, features: tuple | None = None) -> FitResult:
        cfg = self.cfg
        # hourly-grain feature table in the shared checkpoint folder: later plans
        # start from it (small plans, survives executor loss)
        feats, self.state = self._features(df, features)

        members = ["all"]
        if cfg.ensemble:
            counts = {r["m"]: r["n"] for r in feats.groupBy(
                F.when(F.col("is_weekend") == 1, "weekend").otherwise("weekday").alias("m")).count()
                .withColumnRenamed("count", "n").collect()} if "is_weekend" in feats.columns else {}
            need = 10 * cfg.seq_length
            if counts.get("weekday", 0) >= need and counts.get("weekend", 0) >= need:
                members = ["weekday", "weekend"]
            # else: not enough rows for both members → the single model (ML-9 fallback)
        self.scalers = self.fit_scalers(feats, members != ["all"])
        scaled = S.transform(feats, self.scalers, keep=[*self.series, "datetime", RN], target_out=Y)
        seqs = self._sequences(scaled)
        seqs = seqs.withColumn("member", _member_of(F.col("target_time")) if members != ["all"]
                               else F.lit("all"))
        split = chronological_split(seqs, [*self.series, "member"], cfg.test_size, cfg.val_size)
        # written, not cached: nothing stays in memory after the fit, and lost executors cost no sequence
        split = cut_lineage(split.withColumn(VEC, array_to_vector(SEQ)).withColumn("_is_val", F.col("split") == "val"))
        if split.isEmpty():
            raise ValueError("no complete sequence fits into the training rows")

        preds = []
        for m in members:
            part = split.where(F.col("member") == m)
            self.models[m] = fitted_model(cfg, part)
            preds.append(self._score(part.where(F.col("split") == "test"), m))
        test = preds[0]
        for p in preds[1:]:
            test = test.unionByName(p)
        metrics = (M.pooled_metrics(test, "member") if len(members) > 1
                   else M.regression_metrics(test).withColumn("member", F.lit("all")))
        train_samples = split.where(F.col("split") == "train")
        self.result = FitResult(metrics, test, train_samples)
        self.sequences = split
        return self.result

    def _score(self, rows: DataFrame, member: str) -> DataFrame:
        """Model output → trips: null/NaN → 0 (FN-NU7), then inverse min-max."""
        out = self.models[member].transform(rows)
        pred = S.unscale_target(zero_if_null(F.col(PRED)), self.scalers)
        cols = [*self.series, F.lit(member).alias("member"), "datetime", "target_time", F.col(RN)]
        if TARGET in rows.columns:
            cols.append(S.unscale_target(F.col(TARGET), self.scalers).alias("actual"))
        return out.select(*cols, pred.alias("predicted"))

    # ---------------------------------------------------------------- scoring
    def latest_sequences(self, history: DataFrame) -> DataFrame:
        """Sequences ending at the newest row of every series (ML-11, TK-3)."""
        cfg = self.cfg
        if history.isEmpty():
            raise ValueError("there is no history to predict from")
        spec = SPECS[cfg.spec]
        recent = last_n(history, spec.reach + cfg.seq_length, self.series)
        feats, _ = preprocess(recent, spec, self.series, state=self.state, fill_gaps=cfg.fill_gaps)
        scaled = S.transform(feats, self.scalers, keep=[*self.series, "datetime", RN])
        L = cfg.seq_length
        row = F.expr("array(" + ", ".join(q(c) for c in self.state.feature_names) + ")")
        out = halo_window(scaled.select(*self.series, "datetime", RN, *self.carried, row.alias("_row")), self.series,
                          lambda w: {SEQ: F.collect_list("_row").over(w.rowsBetween(-(L - 1), 0)),
                                     "_next": F.lead(F.lit(1), 1).over(w)}, back=L - 1, fwd=1)
        short = out.where(F.col("_next").isNull() & (F.size(SEQ) < L)).limit(1).count()
        if short:
            raise ValueError(f"a series is shorter than one sequence of {L} rows")
        h = 1 if cfg.mode == "next" else cfg.horizon
        return (out.where(F.col("_next").isNull() & (F.size(SEQ) == L))
                .select(*self.series, "datetime", RN, *self.carried, F.flatten(SEQ).alias(SEQ))
                .withColumn("target_time", add_hours("datetime", h))
                .withColumn(VEC, array_to_vector(SEQ)))

    def predict(self, history: DataFrame) -> DataFrame:
        """One forecast per series: ``(series…, last_time, target_time,
        predicted_trips, member)``; ensemble requests are routed by the day type
        of the target time (ML-10, ML-11)."""
        seqs = self.latest_sequences(history)
        return self._route_and_score(seqs).select(
            *self.series, F.col("datetime").alias("last_time"), "target_time",
            F.col("predicted").alias("predicted_trips"), "member")

    def _route_and_score(self, seqs: DataFrame) -> DataFrame:
        if set(self.models) == {"all"}:
            return self._score(seqs, "all")
        # the next-row variant goes by its last row's own day, the others by the target's
        routed = seqs.withColumn("_m", route_member(seqs.drop("target_time") if self.cfg.mode == "next" else seqs))
        parts = [self._score(routed.where(F.col("_m") == m), m) for m in self.models]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def forecast_rows(self, history: DataFrame, forecast: DataFrame) -> DataFrame:
        """Forecast rows after each series' newest history row, once per series (ST-2). A forecast
        without the series columns holds for every series: a series meets the days from its newest one on."""
        last = history.groupBy(*self.series).agg(F.max("datetime").alias("_last")) if self.series else history.agg(F.max("datetime").alias("_last"))
        if self.series and set(self.series) <= set(forecast.columns):
            rows = forecast.join(last, self.series)
        elif self.series:
            told = forecast.drop(*self.series).withColumn("_day", F.to_date("datetime"))
            newest = told.agg(F.max("_day")).first()[0]
            open_ = last.where(F.to_date("_last") <= F.lit(newest)) if newest is not None else last.limit(0)
            days = F.explode(F.sequence(F.to_date("_last"), F.lit(newest).cast("date")))
            rows = open_.select(*self.series, "_last", days.alias("_day")).join(told, "_day").drop("_day")
        else:
            rows = forecast.withColumn("_last", F.lit(last.first()["_last"]))
        return rows.where(F.col("_last").isNull() | (F.col("datetime") > F.col("_last"))).drop("_last")

    def forecast_sequences(self, history: DataFrame, forecast: DataFrame) -> DataFrame:
        """The scaled window before every forecast row, history and earlier forecast rows in it:
        ``(series…, datetime, _rn, seq, target_time, features)`` with the forecast's own time as target
        (WN-9)."""
        cfg, L = self.cfg, self.cfg.seq_length
        spec = SPECS[cfg.spec]
        fc = self.forecast_rows(history, forecast).withColumn("_fc", F.lit(True))
        recent = last_n(history, spec.reach + L, self.series)
        union = recent.unionByName(fc.drop("_fc"), allowMissingColumns=True)
        feats, _ = preprocess(union, spec, self.series, state=self.state, fill_gaps=cfg.fill_gaps)
        scaled = S.transform(feats, self.scalers, keep=[*self.series, "datetime", RN])
        keys = [*self.series, "datetime"]
        seqs = windows_before(scaled, self.state.feature_names, L, self.series, keep=["datetime", *self.carried])
        seqs = seqs.join(fc.select(*keys).distinct(), keys, "left_semi")
        return (seqs.select(*self.series, "datetime", RN, *self.carried, F.flatten(SEQ).alias(SEQ), F.col("datetime").alias("target_time"))
                .withColumn(VEC, array_to_vector(SEQ)))

    def score_forecast(self, history: DataFrame, forecast: DataFrame) -> DataFrame:
        """Forecast-driven scoring (ML-15): every forecast hour of every series is predicted from the
        window before it; output with the forecast's temp / weather_main / is_weekend."""
        keys = [*self.series, "datetime"]
        scored = self._route_and_score(self.forecast_sequences(history, forecast))
        told = [c for c in ("temp", "weather_main", "is_weekend") if c in forecast.columns]
        extra = self.forecast_rows(history, forecast).select(*keys, *told).dropDuplicates(keys)
        return scored.join(extra, keys, "left").select(*keys, "target_time", F.col("predicted").alias("predicted_trips"), *told)

    # -------------------------------------------------------------- importance
    def permutation_importance(self, n_top: int | None = None, seed: int = 42) -> DataFrame:
        """Permutation importance on the training sequences (AN-1): for each
        feature, its whole L-step slice is permuted across samples; importance
        = mean |baseline prediction − perturbed prediction|. One row per member and feature.

        Trees are scored on perturbed copies; a linear model needs none, see ``linear_importance``.
        Shuffle volume stays a few times the training set (not F times):
        * only ids are ranked — feature f's permutation orders the samples by
          ``xxhash64(sample, f, seed)`` with block ranks (no global sort);
        * each feature slice (L values) moves once, to the sample that
          receives it, where the F donor slices are gathered into a map;
        * the F perturbed copies of a sample are generated after the last
          join (``explode``), scored by one ``transform`` and reduced by a
          partial aggregate per feature.
        """
        if self.result is None:
            raise ValueError("fit the model before asking for its importance")
        rows = None
        for member in self.models:
            linear = hasattr(self.models[member], "coefficients") or isinstance(self.models[member], gram.LinearSteps)
            one = self._linear_importance(member, seed) if linear else self._member_importance(member, seed)
            rows = one if rows is None else rows.unionByName(one)
        if n_top:
            rank = F.row_number().over(Window.partitionBy("member").orderBy(F.desc("importance"), "feature"))
            rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= n_top).drop("_rank")
        return rows

    def _linear_importance(self, member: str, seed: int) -> DataFrame:
        model = self.models[member]
        weights = model.weights[0] if isinstance(model, gram.LinearSteps) else model.coefficients.toArray()
        train = self.result.train_samples.where(F.col("member") == member)
        ids = [*self.series, RN]
        return linear_importance(train, SEQ, weights.tolist(), self.state.feature_names, ids, seed).select(
            F.lit(member).alias("member"), "feature", "importance")

    def _member_importance(self, member: str, seed: int) -> DataFrame:
        names = self.state.feature_names
        nf, L = len(names), self.cfg.seq_length
        model = self.models[member]
        train = self.result.train_samples.where(F.col("member") == member)
        # a sample is known by its series and its row there
        base = cut_lineage(model.transform(train).select(F.xxhash64(*self.series, RN).alias("_sid"), SEQ, F.col(PRED).alias("_base")))
        feats = F.explode(F.sequence(F.lit(0), F.lit(nf - 1))).alias("_f")
        # position of every sample (0-based) and, per feature, its rank under the hash order
        idx = add_row_index(base.select("_sid"), "_sid", name="_i",
                            bucket=F.shiftright(F.col("_sid"), 52)).select("_sid", (F.col("_i") - 1).alias("_i"))
        keys = idx.select("_sid", feats).withColumn("_k", F.xxhash64("_sid", "_f", F.lit(seed)))
        ranked = add_row_index(keys, "_k", ["_f"], tiebreak=["_sid"], name="_r",
                               bucket=F.shiftright(F.col("_k"), 52))
        # the sample at position r-1 receives feature f from sample _sid
        mapping = ranked.select("_f", F.col("_sid").alias("_donor"), (F.col("_r") - 1).alias("_i"))
        slices = base.select(F.col("_sid").alias("_donor"), feats, SEQ).select(
            "_donor", "_f", F.transform(F.sequence(F.lit(0), F.lit(L - 1)),
                                        lambda t: F.col(SEQ)[t * nf + F.col("_f")]).alias("_slice"))
        received = (mapping.join(slices, ["_donor", "_f"])
                    .groupBy("_i").agg(F.map_from_entries(F.collect_list(F.struct("_f", "_slice"))).alias("_don")))
        copies = (base.join(idx, "_sid").join(received, "_i")
                  .select("_base", SEQ, "_don", feats))
        perturbed = copies.select(
            "_f", "_base",
            array_to_vector(F.transform(SEQ, lambda x, k: F.when(
                k % nf == F.col("_f"), F.element_at(F.col("_don"), F.col("_f"))[(k / nf).cast("int")])
                .otherwise(x))).alias(VEC))
        scored = model.transform(perturbed)
        imp = scored.groupBy("_f").agg(F.avg(F.abs(F.col(PRED) - F.col("_base"))).alias("importance"))
        name_arr = F.array(*[F.lit(n) for n in names])
        return imp.select(F.lit(member).alias("member"), name_arr[F.col("_f")].alias("feature"), "importance")

    # ------------------------------------------------------------ persistence
    def save(self, path: str) -> None:
        """Models (one folder per member) + config / features / scalers (SNK-4)."""
        save_models(path, self.models, self.cfg, self)

    @classmethod
    def load(cls, path: str) -> "Forecaster":
        """Single or ensemble model, by the member list in the saved metadata (SRC-8)."""
        cfg, state, scalers, models = load_models(path)
        f = cls(cfg)
        f.state, f.scalers, f.models = state, scalers, models
        return f


def save_models(path: str, models: dict, cfg: ModelConfig, fitted: Forecaster) -> None:
    spark = SparkSession.getActiveSession()
    for name, model in models.items():
        if isinstance(model, gram.LinearSteps):
            spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
        else:
            model.write().overwrite().save(f"{path}/{name}")
    if isinstance(fitted.scalers, S.SeriesScalers):
        fitted.scalers.table.write.mode("overwrite").parquet(f"{path}/scalers")
    for name, table in fitted.state.tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    meta = {"config": asdict(cfg), "state": fitted.state.to_dict(), "scalers": fitted.scalers.to_dict(),
            "members": [str(name) for name in models], "tables": list(fitted.state.tables)}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_models(path: str) -> tuple[ModelConfig, FeatureState, S.Scalers, dict]:
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    cfg = ModelConfig(**{**meta["config"], "series_cols": tuple(meta["config"].get("series_cols") or ())})
    if cfg.algorithm == "ridge":
        models = {m: gram.LinearSteps.from_json(spark.read.text(f"{path}/{m}").first()[0]) for m in meta["members"]}
    else:
        loader = LinearRegressionModel if cfg.algorithm == "linear" else GBTRegressionModel
        models = {m: loader.load(f"{path}/{m}") for m in meta["members"]}
    state = FeatureState.from_dict(meta["state"])
    state.tables = {name: spark.read.parquet(f"{path}/{name}") for name in meta.get("tables", [])}
    if "by" in meta["scalers"]:
        scalers = S.SeriesScalers(**meta["scalers"], table=spark.read.parquet(f"{path}/scalers"))
    else:
        scalers = S.Scalers.from_dict(meta["scalers"])
    return cfg, state, scalers, models


class MultiStepForecaster:
    """Direct multi-step forecaster: one model per step 1…H (ML-13, ML-14, AG-17)."""

    def __init__(self, config: ModelConfig | None = None, **overrides):
        base = replace(config or ModelConfig(seq_length=8, horizon=6), **overrides)
        self.cfg = replace(base, mode="multi", ensemble=False)
        self.inner = Forecaster(replace(self.cfg, mode="fixed"))
        self.models: dict[int, object] = {}
        self.metrics: DataFrame | None = None
        self.sequences: DataFrame | None = None  # all labelled sequences of the fit

    def fit(self, df: DataFrame, features: tuple | None = None) -> DataFrame:
        cfg, inner = self.cfg, self.inner
        feats, inner.state = inner._features(df, features)
        inner.scalers = inner.fit_scalers(feats)
        scaled = S.transform(feats, inner.scalers, keep=[*inner.series, "datetime", RN], target_out=Y)
        seqs = build_sequences(scaled, inner.state.feature_names, Y, cfg.seq_length, cfg.horizon,
                               inner.series, mode="multi", keep=("datetime", S.LOW, S.RANGE))
        split = chronological_split(seqs, inner.series, cfg.test_size, cfg.val_size)
        if cfg.algorithm == "ridge":
            return self._fit_ridge(split)
        split = cut_lineage(split.withColumn(VEC, array_to_vector(SEQ)).withColumn("_is_val", F.col("split") == "val"))
        if split.isEmpty():
            raise ValueError("no complete sequence fits into the training rows")
        self.sequences = split
        preds = []
        for h in range(1, cfg.horizon + 1):
            part = split.withColumn(TARGET, F.col(TARGETS)[h - 1])
            self.models[h] = fitted_model(cfg, part)
            out = self.models[h].transform(part.where(F.col("split") == "test"))
            preds.append(out.select(
                *inner.series, F.lit(h).alias("hours_ahead"), "datetime",
                S.unscale_target(F.col(TARGET), inner.scalers).alias("actual"),
                S.unscale_target(zero_if_null(F.col(PRED)), inner.scalers).alias("predicted")))
        test = preds[0]
        for p in preds[1:]:
            test = test.unionByName(p)
        self.test_predictions = test
        self.metrics = M.regression_metrics(test, group_cols=["hours_ahead"])
        return self.metrics

    def _fit_ridge(self, split: DataFrame) -> DataFrame:
        """All steps from one pass over the training sequences, their test rows from another."""
        sums = gram.gram_of(split.where(F.col("split") == "train"), SEQ, TARGETS)
        if sums is None:
            raise ValueError("no complete sequence fits into the training rows")
        self.sums = sums
        model = gram.solve(sums, *elastic_net(self.cfg.reg_type, self.cfg.reg_value))
        self.models = {h: gram.LinearSteps(model.weights[h - 1 : h], model.intercepts[h - 1 : h]) for h in range(1, self.cfg.horizon + 1)}
        self.test_predictions = self._step_rows(split.where(F.col("split") == "test"), model)
        self.metrics = M.regression_metrics(self.test_predictions, group_cols=["hours_ahead"])
        return self.metrics

    def _step_rows(self, rows: DataFrame, model: gram.LinearSteps, *keep: Column) -> DataFrame:
        """(series…, hours_ahead, datetime, actual, predicted): the H rows of every sequence in one projection."""
        inner = self.inner
        pairs = F.arrays_zip(F.col(TARGETS).alias("t"), model.predictions(SEQ).alias("p"))
        told = rows.select("*", F.posexplode(pairs).alias("_step", "_pair"))
        return told.select(*keep, *inner.series, (F.col("_step") + 1).alias("hours_ahead"), "datetime",
                           S.unscale_target(F.col("_pair.t"), inner.scalers).alias("actual"),
                           S.unscale_target(zero_if_null(F.col("_pair.p")), inner.scalers).alias("predicted"))

    def fit_penalties(self, df: DataFrame, penalties: dict[str, tuple[str | None, float]], features: tuple | None = None) -> DataFrame:
        """Test metrics of every penalty ``name: (reg_type, reg_value)`` and step (ML-6, ML-16): the penalties
        share one Gram matrix, and all their predictions one pass over the test sequences."""
        if self.cfg.algorithm != "ridge":
            raise ValueError("penalties share one pass with algorithm='ridge'")
        cfg, inner = self.cfg, self.inner
        feats, inner.state = inner._features(df, features)
        inner.scalers = inner.fit_scalers(feats)
        scaled = S.transform(feats, inner.scalers, keep=[*inner.series, "datetime", RN], target_out=Y)
        seqs = build_sequences(scaled, inner.state.feature_names, Y, cfg.seq_length, cfg.horizon,
                               inner.series, mode="multi", keep=("datetime", S.LOW, S.RANGE))
        split = chronological_split(seqs, inner.series, cfg.test_size, cfg.val_size)
        sums = gram.gram_of(split.where(F.col("split") == "train"), SEQ, TARGETS)
        if sums is None:
            raise ValueError("no complete sequence fits into the training rows")
        models = [gram.solve(sums, *elastic_net(*p)) for p in penalties.values()]
        both = gram.LinearSteps(np.concatenate([m.weights for m in models]), np.concatenate([m.intercepts for m in models]))
        rows = split.where(F.col("split") == "test").withColumn(TARGETS, F.flatten(F.array_repeat(TARGETS, len(models))))
        H = cfg.horizon
        rows = self._step_rows(rows, both)
        names = F.array(*[F.lit(n) for n in penalties])
        rows = rows.withColumn("penalty", names[((F.col("hours_ahead") - 1) / H).cast("int")])
        rows = rows.withColumn("hours_ahead", ((F.col("hours_ahead") - 1) % H + 1).cast("int"))
        return M.regression_metrics(rows, group_cols=["penalty", "hours_ahead"])

    def save(self, path: str) -> None:
        """One model folder per step, and the metadata (SNK-4)."""
        save_models(path, self.models, self.cfg, self.inner)

    @classmethod
    def load(cls, path: str) -> "MultiStepForecaster":
        """The forecaster that ``save`` has written (SRC-8)."""
        cfg, state, scalers, models = load_models(path)
        f = cls(cfg)
        f.inner.state, f.inner.scalers = state, scalers
        f.models = {int(h): m for h, m in models.items()}
        return f

    def predict_ahead(self, history: DataFrame, steps_to_show: int | None = None) -> DataFrame:
        """Forecasts for steps 1 … min(steps, H) after the newest row (ML-14)."""
        steps = min(steps_to_show or self.cfg.horizon, self.cfg.horizon)
        seqs = self.inner.latest_sequences(history)
        out = []
        for h in range(1, steps + 1):
            p = self.models[h].transform(seqs)
            out.append(p.select(*self.inner.series, F.lit(h).alias("hours_ahead"),
                                add_hours("datetime", h).alias("datetime"),
                                S.unscale_target(zero_if_null(F.col(PRED)), self.inner.scalers)
                                .alias("predicted_trips")))
        res = out[0]
        for p in out[1:]:
            res = res.unionByName(p)
        return res


def run_complete_pipeline(df: DataFrame, base_seq_length: int = 8, algorithm: str = "gbt",
                          save_to: str | None = None) -> dict:
    """The full comparison (ML-17): next-row base model with its importance, category, correlation and
    unexpected-feature tables → weekday/weekend ensemble of the same features → direct multi-step model.
    Returns the result tables by name; with ``save_to`` every model is written below that folder."""
    out: dict = {}
    spec = "base"
    features = materialized_features(df, spec)
    base = Forecaster(ModelConfig(spec=spec, mode="next", seq_length=base_seq_length, algorithm=algorithm))
    out["base_metrics"] = base.fit(df, features).metrics
    imp = out["importance"] = base.permutation_importance()
    one = imp.select("feature", "importance")
    out["categories"] = analysis.category_importance(one, spec)
    out["correlations"] = correlation_top(features[0], one)
    out["unexpected"] = analysis.unexpected_features(features[0], one)
    ens = Forecaster(ModelConfig(spec=spec, seq_length=base_seq_length, ensemble=True, algorithm=algorithm))
    out["ensemble_metrics"] = ens.fit(df, features).metrics
    ms = MultiStepForecaster(ModelConfig(spec=spec, seq_length=base_seq_length, horizon=6, algorithm=algorithm))
    out["multistep_metrics"] = ms.fit(df, features)
    out["forecast_ahead"] = ms.predict_ahead(df, 6)
    if save_to:
        for name, model in (("base", base), ("ensemble", ens), ("multistep", ms)):
            model.save(f"{save_to}/{name}")
    return out


def correlation_top(feats: DataFrame, importance: DataFrame, n: int = 15) -> DataFrame:
    """Correlations among the target and the ``n`` most important features (AN-4)."""
    names = [r["feature"] for r in importance.orderBy(F.desc("importance"), "feature").limit(n).collect()]
    return analysis.correlation_long(feats, ["trip_count", *names])


def run_experiments(df: DataFrame, param_sets: dict[str, dict] | None = None,
                    base: ModelConfig | None = None, features: tuple | None = None) -> DataFrame:
    """Named parameter sets → one metrics table (ML-16). Features are computed
    once and shared by every run; the split stays chronological."""
    param_sets = param_sets or PRESETS
    base = base or ModelConfig()
    if features is None:
        features = materialized_features(df, base.spec, list(base.series_cols), base.fill_gaps)
    feats = features
    rows = None
    for name, overrides in param_sets.items():
        f = Forecaster(base, **overrides)
        res = f.fit(df, features=feats)
        m = res.metrics.where(F.col("member") == "all").select(
            F.lit(name).alias("experiment"), F.lit(json.dumps(overrides, sort_keys=True)).alias("params"),
            "n", "mae", "rmse", "r2", "smape", "huber")
        rows = m if rows is None else rows.unionByName(m)
    return rows
