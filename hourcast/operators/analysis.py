"""Profiles, correlations and feature-importance analysis
(AG-10, AG-11, AG-13, AG-19, AN-3..5, FLT-5, FLT-6, JN-4, FN-ST2).

Wide statistics are one aggregate with one expression per column (or pair),
turned long with ``unpivot``: no pairs of rows are ever materialised.
Correlation is ``covar_samp / (stddev_x · stddev_y)`` through ``try_divide``,
so a constant column yields null (pandas NaN) instead of an ANSI error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.operators.windows import RN, add_row_index, halo_window

# Feature categories and their name patterns per variant
# (a feature belongs to a category when its name contains a pattern).
CATEGORY_PATTERNS = {
    "h2": {
        "Weather": ["temp", "feels_like", "humidity", "rain_1h", "snow_1h", "wind_speed", "clouds"],
        "Time": ["hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos",
                 "day_of_week_sin", "day_of_week_cos"],
        "Special Periods": ["is_weekend", "is_holiday", "is_rush_hour_am", "is_rush_hour_pm",
                            "is_business_hours", "is_night"],
        "Historical": ["trip_count_lag_1", "trip_count_lag_2", "trip_count_lag_3",
                       "trip_count_ma_2h", "trip_count_ma_3h", "trip_count_ma_6h",
                       "trip_count_std_2h", "trip_count_std_3h", "trip_count_std_6h",
                       "trip_count_diff_1", "trip_count_diff_2", "trip_count_diff_3"],
    },
    "h3": {
        "Weather": ["temp", "feels_like", "humidity", "rain_1h", "snow_1h", "wind_speed", "clouds"],
        "Time": ["hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos",
                 "day_of_week_sin", "day_of_week_cos"],
        "Special Periods": ["is_weekend", "is_holiday", "is_rush_hour_am", "is_rush_hour_pm",
                            "is_business_hours", "is_night"],
        "Historical": ["trip_count_lag_1", "trip_count_lag_2", "trip_count_lag_3",
                       "trip_count_ma_3h", "trip_count_ma_6h", "trip_count_ma_12h",
                       "trip_count_std_3h", "trip_count_std_6h", "trip_count_std_12h",
                       "trip_count_diff_1", "trip_count_diff_3", "trip_count_diff_6"],
    },
    "h24": {
        "Weather": ["temp", "feels_like", "humidity", "rain_1h", "snow_1h", "wind_speed", "clouds"],
        "Time": ["hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos",
                 "day_of_week_sin", "day_of_week_cos"],
        "Special Periods": ["is_weekend", "is_holiday", "is_rush_hour_am", "is_rush_hour_pm",
                            "is_business_hours", "is_night"],
        "Historical": ["trip_count_lag_1", "trip_count_lag_2", "trip_count_lag_3",
                       "trip_count_ma_3h", "trip_count_ma_6h", "trip_count_ma_12h",
                       "trip_count_lag_24", "trip_count_ma_24h", "trip_count_std_24h",
                       "trip_count_lag_48", "trip_count_ma_48h", "trip_count_std_48h"],
    },
    "base": {
        "Weather": ["temp", "feels_like", "humidity", "rain_1h", "snow_1h", "wind_speed", "clouds"],
        "Time": ["hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos",
                 "day_of_week_sin", "day_of_week_cos"],
        "Special Periods": ["is_weekend", "is_holiday", "is_rush_hour_am", "is_rush_hour_pm",
                            "is_business_hours", "is_night"],
        "Historical": ["trip_count_lag_1", "trip_count_lag_2", "trip_count_lag_3",
                       "trip_count_ma_3h", "trip_count_ma_6h", "trip_count_ma_12h"],
    },
}


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def corr_expr(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both sides are known (pandas ``corr``); null when
    either side is constant there."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, long form ``(column_name, null_count, total_rows)`` (AG-10)."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count_if(_q(c).isNull()).cast("long").alias(f"__n{i}") for i, c in enumerate(cols)])
    long = wide.unpivot(["__rows"], [f"__n{i}" for i in range(len(cols))], "__key", "null_count")
    names = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(f"__n{i}"), F.lit(c))])
    return long.select(names[F.col("__key")].alias("column_name"), "null_count",
                       F.col("__rows").alias("total_rows"))


def column_types(df: DataFrame) -> DataFrame:
    """``(column_name, dtype, null_count)``, kinds named as a data frame library shows them (AG-11): whole numbers
    with nulls are ``float64`` there."""
    kinds = {}
    for f in df.schema.fields:
        t = f.dataType
        kinds[f.name] = ("int64" if isinstance(t, T.IntegralType) else "float64" if isinstance(t, T.NumericType)
                         else "datetime64[ns]" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))
                         else "bool" if isinstance(t, T.BooleanType) else "object")
    kind = F.create_map(*[x for c, k in kinds.items() for x in (F.lit(c), F.lit(k))])[F.col("column_name")]
    nulls = null_profile(df)
    dtype = F.when((kind == "int64") & (F.col("null_count") > 0), "float64").when((kind == "bool") & (F.col("null_count") > 0), "object").otherwise(kind)
    return nulls.select("column_name", dtype.alias("dtype"), "null_count")


def target_profile(df: DataFrame, target: str = "trip_count") -> DataFrame:
    """Row / column counts and min, max, mean, zeros, nulls of the target (AG-11)."""
    t = _q(target).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
                  F.min(t).alias("min_value"), F.max(t).alias("max_value"), F.avg(t).alias("mean_value"),
                  F.count_if(t == 0).alias("zero_count"), F.count_if(t.isNull()).alias("null_count"))


def wide_to_long(wide: DataFrame, names: Sequence[str], value: str) -> DataFrame:
    """One-row aggregate with columns ``__v{i}`` → ``(feature, value)``."""
    long = wide.unpivot([], [f"__v{i}" for i in range(len(names))], "__key", value)
    m = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(f"__v{i}"), F.lit(c))])
    return long.select(m[F.col("__key")].alias("feature"), value)


def corr_with(df: DataFrame, features: Sequence[str], y: str, value: str = "corr",
              absolute: bool = False) -> DataFrame:
    """``(feature, corr(feature, y))`` for many features, in long form:
    ``(k, v, y)`` rows and one ``groupBy(k)`` (small generated code for any
    number of features; no pairs of rows)."""
    from hourcast.functions.sqlexpr import q

    pairs = ", ".join(f"named_struct('k', {i}, 'v', CAST({q(c)} AS DOUBLE), 'y', CAST({q(y)} AS DOUBLE))"
                      for i, c in enumerate(features))
    lv = df.selectExpr(f"inline(array({pairs}))")
    c = corr_expr(F.col("v"), F.col("y"))
    agg = lv.groupBy("k").agg((F.abs(c) if absolute else c).alias(value))
    name = F.array(*[F.lit(f) for f in features])
    return agg.select(name[F.col("k")].alias("feature"), value)


def linear_importance(df: DataFrame, features: Sequence[str], target: str = "trip_count", H: int = 2,
                      series_cols: Sequence[str] = ()) -> DataFrame:
    """Deterministic importance: |corr(feature_t, target_{t+H})| per feature.

    A model-free stand-in for permutation importance, used by the analysis
    operators when no trained model is given (rows without a target H rows
    ahead are ignored).
    """
    series = list(series_cols)
    base = df if RN in df.columns else add_row_index(df, "datetime", series)
    ahead = halo_window(base, series, lambda w: {"_y_ahead": F.lead(_q(target).cast("double"), H).over(w)},
                        back=0, fwd=H)
    ahead = ahead.where(F.col("_y_ahead").isNotNull())
    return corr_with(ahead, list(features), "_y_ahead", "importance", absolute=True)


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation matrix of ``cols`` as ``(feature_1, feature_2, corr)`` (AG-19, AN-4).
    Each unordered pair is computed once and mirrored."""
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    wide = df.agg(*[corr_expr(_q(cols[i]).cast("double"), _q(cols[j]).cast("double")).alias(f"__v{k}")
                    for k, (i, j) in enumerate(pairs)])
    names = [f"{i}|{j}" for i, j in pairs]
    long = wide_to_long(wide, names, "corr")
    ij = F.split(F.col("feature"), r"\|")
    name = F.array(*[F.lit(c) for c in cols])
    a, b = ij[0].cast("int"), ij[1].cast("int")
    half = long.select(name[a].alias("feature_1"), name[b].alias("feature_2"), "corr")
    mirror = long.where(a != b).select(name[b].alias("feature_1"), name[a].alias("feature_2"), "corr")
    return half.unionByName(mirror)


def feature_categories(imp: DataFrame, variant: str = "h2", feature: str = "feature") -> DataFrame:
    """``(category, feature)`` for every substring match, each pair once (FN-ST2, FLT-5)."""
    pats = CATEGORY_PATTERNS[variant]
    table = F.array(*[F.struct(F.lit(cat).alias("category"), F.lit(p).alias("pattern"))
                      for cat, ps in pats.items() for p in ps])
    hits = F.filter(table, lambda s: F.col(feature).contains(s["pattern"]))
    return (imp.select(feature, "importance", F.explode(hits).alias("_h"))
            .select(F.col("_h.category").alias("category"), feature, "importance")
            .dropDuplicates(["category", feature]))


def category_importance(imp: DataFrame, variant: str = "h2") -> DataFrame:
    """Summed importance per category, its share of the category total (AN-3, AG-13), and its rank by
    importance, ties by name (TK-7). Categories without a matching feature report 0."""
    pats = CATEGORY_PATTERNS[variant]
    cats = imp.sparkSession.createDataFrame([(c,) for c in pats], "category string")
    sums = feature_categories(imp, variant).groupBy("category").agg(F.sum("importance").alias("importance"))
    # ≤ 4 rows: the share window over all categories is a one-partition step on a tiny table
    out = cats.join(sums, "category", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    total = F.sum("importance").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("importance"), "category"))
    return out.withColumn("share", F.try_divide(F.col("importance"), total)).withColumn("rank", rank)


def unexpected_features(df: DataFrame, imp: DataFrame, target: str = "trip_count", top_n: int = 15,
                        threshold: float = 0.3) -> DataFrame:
    """Top-n features with importance above the mean importance but
    |corr(feature, target)| below ``threshold`` (AN-5, FLT-6, JN-4)."""
    from hourcast.operators.topk import top_importance

    top = top_importance(imp, top_n)
    names = [r["feature"] for r in top.select("feature").collect()]
    corr = corr_with(df, names, target, "corr")
    mean_imp = imp.agg(F.avg("importance")).first()[0]  # one fitted scalar
    if mean_imp is None:
        return top.select("feature", "importance", F.lit(None).cast("double").alias("abs_corr"), "rank").limit(0)
    return (top.join(corr, "feature")
            .where((F.col("importance") > F.lit(mean_imp)) & (F.abs("corr") < threshold))
            .select("feature", "importance", F.abs("corr").alias("abs_corr"), "rank"))
