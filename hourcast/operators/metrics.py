"""Forecast evaluation (AG-14..18, FN-MA8, AN-6, TK-8).

All metrics are one mergeable aggregate over ``(actual, predicted)``; grouped
variants add keys (``hours_ahead``, ``member``) and the pooled ensemble figure
comes from the same pass through ``rollup``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.operators.windows import RN, halo_window

SMAPE_EPS = 1e-10  # fixed value of the reference's SMAPE
HUBER_DELTA = 1.0  # fixed value of the reference's Huber loss


def smape(actual: Column, predicted: Column) -> Column:
    """Mean of 2·|p − t| / (|t| + |p| + 1e-10), in [0, 2] (AG-15)."""
    return F.avg(F.lit(2.0) * F.abs(predicted - actual) /
                 (F.abs(actual) + F.abs(predicted) + F.lit(SMAPE_EPS)))


def huber(actual: Column, predicted: Column, delta: float = HUBER_DELTA) -> Column:
    """Mean Huber loss (AG-16)."""
    e = F.abs(predicted - actual)
    d = F.lit(delta)
    return F.avg(F.when(e <= d, F.lit(0.5) * e * e).otherwise(d * e - F.lit(0.5) * d * d))


def metric_columns(actual: str = "actual", predicted: str = "predicted") -> list[Column]:
    """n, MAE, RMSE, R², SMAPE, Huber (AG-14..16). R² follows sklearn with
    ``force_finite``: a constant target gives 1 for a perfect fit, else 0."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = p - a
    n = F.count(a)
    sse = F.sum(e * e)
    sst = F.var_pop(a) * n
    r2 = F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        F.lit(1.0) - F.try_divide(sse, sst))
    return [n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            r2.alias("r2"), smape(a, p).alias("smape"), huber(a, p).alias("huber")]


def regression_metrics(pred: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       group_cols: Sequence[str] = ()) -> DataFrame:
    g = list(group_cols)
    cols = metric_columns(actual, predicted)
    return pred.groupBy(*g).agg(*cols) if g else pred.agg(*cols)


def pooled_metrics(pred: DataFrame, member_col: str = "member", actual: str = "actual",
                   predicted: str = "predicted", pooled_name: str = "all") -> DataFrame:
    """Metrics per ensemble member plus the pooled union of their test rows
    (AG-18, ST-3), in one ``rollup`` aggregation."""
    return (pred.rollup(member_col).agg(*metric_columns(actual, predicted))
            .withColumn(member_col, F.coalesce(F.col(member_col), F.lit(pooled_name))))


def with_errors(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """residual = actual − predicted, abs_error = |residual| (FN-MA8)."""
    r = F.col(actual) - F.col(predicted)
    return pred.withColumns({"residual": r, "abs_error": F.abs(r)})


def residual_series(pred: DataFrame, n_samples: int = 200, order_col: str = RN) -> DataFrame:
    """Actual / predicted / residual of the first ``n_samples`` rows (AN-6, TK-8)."""
    return with_errors(pred).orderBy(order_col).limit(n_samples)


def persistence_forecast(df: DataFrame, target: str, H: int, series_cols: Sequence[str] = (),
                         ts_col: str = "datetime") -> DataFrame:
    """Deterministic baseline: predict the value H rows later with today's.

    Output ``(series…, _rn, target_time, actual, predicted)`` for every row that
    has a value H rows earlier.
    """
    series = list(series_cols)
    out = halo_window(df.select(*series, ts_col, RN, target), series,
                      lambda w: {"predicted": F.lag(F.col(target).cast("double"), H).over(w)}, back=H)
    return out.where(F.col("predicted").isNotNull()).select(
        *series, RN, F.col(ts_col).alias("target_time"),
        F.col(target).cast("double").alias("actual"), "predicted")


def persistence_by_horizon(df: DataFrame, target: str, H: int, series_cols: Sequence[str] = (),
                           ts_col: str = "datetime") -> DataFrame:
    """Long ``(hours_ahead, actual, predicted)`` for steps 1…H, one window pass (AG-17)."""
    series = list(series_cols)
    y = F.col(target).cast("double")
    out = halo_window(df.select(*series, ts_col, RN, target), series,
                      lambda w: {"_steps": F.array(*[
                          F.struct(F.lit(h).alias("hours_ahead"), F.lag(y, h).over(w).alias("predicted"))
                          for h in range(1, H + 1)])}, back=H)
    return (out.select(*series, RN, ts_col, y.alias("actual"), F.explode("_steps").alias("_s"))
            .select(*series, RN, F.col(ts_col).alias("target_time"), F.col("_s.hours_ahead").alias("hours_ahead"),
                    "actual", F.col("_s.predicted").alias("predicted"))
            .where(F.col("predicted").isNotNull()))
