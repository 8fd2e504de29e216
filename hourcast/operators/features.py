"""Hourly feature engineering (the reference's ``preprocess_data``):
imputation, lags / rolling / differences, holiday and calendar flags,
interactions, cyclical encodings, one-hot weather, final imputation
(WN-1..4, FN-FL*, FN-MA1..6, FN-NU1..4, FN-CA1/2, PRJ-6..8, AG-5/6/9).

One spec object per reference variant replaces the five copies. Everything is
built-in Spark expressions; per-column statistics (medians, mode, category
list) are one-row aggregates collected as fitted parameters.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.functions.calendar import calendar_sql, cyclical_sql, with_is_holiday
from hourcast.functions.sqlexpr import lit, project, q
from hourcast.functions.nulls import normalize_missing, numeric_columns
from hourcast.operators.aggregate import fill_hour_gaps
from hourcast.operators.quantiles import summarize, summarize_by
from hourcast.operators.windows import RN, add_row_index, halo_window, lag_sql, window_reach
from hourcast.sources.trips import as_timestamp


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    lags: tuple[int, ...]
    ma: tuple[int, ...]
    std: tuple[int, ...]
    diff: tuple[int, ...]
    day_hour_flags: bool
    one_hot: str  # "training": categories fixed at fit time; "frame": categories of the frame

    @property
    def reach(self) -> int:
        return window_reach(self.lags, self.ma, self.std, self.diff)


# The four feature sets of the reference variants.
SPECS: dict[str, FeatureSpec] = {
    "h2": FeatureSpec("h2", (1, 2, 3, 6, 9, 12, 24), (2, 3, 6, 12, 24), (2, 3, 6, 12, 24),
                      (1, 2, 3, 6, 12, 24), True, "training"),
    "h2_frame": FeatureSpec("h2_frame", (1, 2, 3, 6, 9, 12, 24), (2, 3, 6, 12, 24), (2, 3, 6, 12, 24),
                            (1, 2, 3, 6, 12, 24), True, "frame"),
    "h3": FeatureSpec("h3", (1, 2, 3, 6, 9, 12, 24), (3, 6, 12, 24), (3, 6, 12, 24),
                      (1, 3, 6, 12, 24), True, "frame"),
    "h24": FeatureSpec("h24", (1, 2, 3, 6, 12, 24, 48), (3, 6, 12, 24, 48), (24, 48),
                       (1, 24, 48), True, "frame"),
    "base": FeatureSpec("base", (1, 2, 3, 6, 12, 24), (3, 6, 12, 24), (24,), (1, 24), False, "frame"),
}

# Columns dropped before modelling.
NON_FEATURE_COLUMNS = ("weather_main", "weather_description", "weather_icon", "sunrise", "sunset",
                       "timezone", "datetime", "date")

TARGET = "trip_count"


@dataclass
class FeatureState:
    """Fitted preprocessing parameters (serving reuses them)."""
    spec: str
    series_cols: list[str]
    medians_pre: dict[str, float | None] = field(default_factory=dict)
    zero_cols: list[str] = field(default_factory=list)
    weather_mode: str | None = None
    weather_categories: list[str] | None = None
    medians_post: dict[str, float | None] = field(default_factory=dict)
    feature_names: list[str] = field(default_factory=list)
    #: with series: the columns that each of ``tables`` holds medians of, in order
    median_columns: dict[str, list[str]] = field(default_factory=dict)
    #: with series: medians per series as stored tables ``(series…, medians)``
    tables: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def to_dict(self) -> dict:
        return asdict(replace(self, tables={}))

    @classmethod
    def from_dict(cls, d: dict) -> "FeatureState":
        return cls(**d)


def category_counts(df: DataFrame, col: str = "weather_main") -> list[tuple[str, int]]:
    """Rows per non-null category (one small grouped count; categories are few)."""
    return [(r[0], int(r[1])) for r in
            df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1))).collect()]


def mode_of(counts: list[tuple[str, int]]) -> str | None:
    """Most frequent category, lowest on ties (AG-6)."""
    return min(counts, key=lambda kv: (-kv[1], kv[0]))[0] if counts else None


def distinct_categories(df: DataFrame, col: str = "weather_main") -> list[str]:
    """Distinct non-null categories, sorted (AG-9). Small by construction."""
    return [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).collect()]


def impute_pass1(df: DataFrame, keys: Sequence[str], state: FeatureState | None,
                 fit: bool) -> tuple[DataFrame, dict[str, float | None], list[str]]:
    """Median fill of numeric columns; all-null columns become 0 (FN-NU2)."""
    cols = numeric_columns(df, exclude=keys)
    if fit:
        summ = summarize(df, cols, [0.5])
        # every median is kept: a column without nulls here may have some when scoring
        medians = {c: summ.quantiles[c][0] for c in cols if summ.quantiles[c][0] is not None}
        zero = [c for c in cols if summ.nulls[c] > 0 and c not in medians]
        needed = {c: v for c, v in medians.items() if summ.nulls[c] > 0}
    else:
        have = set(df.columns)
        medians = {c: v for c, v in state.medians_pre.items() if c in have}
        zero = [c for c in state.zero_cols if c in have]
        needed = medians
    fills = {c: f"coalesce(CAST({q(c)} AS DOUBLE), {lit(float(v))})" for c, v in needed.items()}
    fills.update({c: f"coalesce(CAST({q(c)} AS DOUBLE), 0.0)" for c in zero})
    return (project(df, fills) if fills else df), medians, zero


def series_medians(df: DataFrame, cols: list[str], series: list[str]) -> tuple[DataFrame, list[str]]:
    """(medians of every series as a stored table ``(series…, medians)``, the columns with nulls)."""
    from hourcast.session import cut_lineage

    stats = cut_lineage(summarize_by(df, cols, [0.5], series))
    some = {r["k"] for r in stats.groupBy("k").agg(F.sum("nulls").alias("n")).where("n > 0").collect()}
    ordered = F.array_sort(F.collect_list(F.struct("k", F.col("q")[0].alias("m"))))
    table = stats.groupBy(*(q(c) for c in series)).agg(ordered["m"].alias("medians"))
    return cut_lineage(table), [c for i, c in enumerate(cols) if i in some]


def fill_by_series(df: DataFrame, table: DataFrame, cols: list[str], which: Sequence[str], series: list[str], rest: str) -> DataFrame:
    """Nulls of the columns ``which`` become the median of their series, or ``rest`` where it has none."""
    told = table.select(*(F.col(q(c)).alias(f"_s{i}") for i, c in enumerate(series)), F.col("medians").alias("_medians"))
    on = F.lit(True)
    for i, c in enumerate(series):
        on = on & F.col(q(c)).eqNullSafe(F.col(f"_s{i}"))
    at = {c: i for i, c in enumerate(cols)}
    have = df.columns
    fills = {c: f"coalesce(CAST({q(c)} AS DOUBLE), _medians[{at[c]}], {rest})" for c in which if c in have and c in at}
    return project(df.join(told, on, "left"), fills, columns=have) if fills else df


def materialized_features(df: DataFrame, spec: FeatureSpec | str = "h2",
                          series_cols: Sequence[str] = (), fill_gaps: bool = False) -> tuple[DataFrame, FeatureState]:
    """Fit and materialise the feature table in the shared checkpoint folder,
    then release the caches used while fitting."""
    from hourcast.session import cut_lineage

    cached: list = []
    out, st = preprocess(df, spec, series_cols, cached=cached, fill_gaps=fill_gaps)
    out = cut_lineage(out)
    for c in cached:
        c.unpersist()
    return out, st


def preprocess(df: DataFrame, spec: FeatureSpec | str = "h2", series_cols: Sequence[str] = (),
               state: FeatureState | None = None, add_lags: bool = True,
               keep_keys: bool = True, cached: list | None = None,
               fill_gaps: bool = False) -> tuple[DataFrame, FeatureState]:
    """Feature table of an hourly (enriched) series.

    ``state=None`` fits the imputation medians, weather mode and categories on
    ``df``; passing a fitted state reuses them (serving). Output keeps
    ``datetime``, the series columns and ``_rn`` (row position) as keys next to
    ``trip_count`` and the numeric features; ``state.feature_names`` lists the
    features in order. Frames cached while fitting are appended to ``cached``
    so a caller that materialises the result can release them. ``fill_gaps``
    first puts the series on a dense hour grid (missing hours count 0, their
    weather is imputed), so lags count hours instead of rows.
    """
    spec = SPECS[spec] if isinstance(spec, str) else spec
    series = list(series_cols)
    fit = state is None
    st = FeatureState(spec.name, series) if fit else state

    data = df
    has_dt = "datetime" in data.columns
    if has_dt:
        data = data.withColumn("datetime", as_timestamp(data, "datetime"))
    if fill_gaps and has_dt:
        data = fill_hour_gaps(data, series)
    data = normalize_missing(data)

    keys = [*series, "datetime", RN]
    if fit:
        # hourly grain (≤ one row per series and hour): cached once, scanned by
        # the fitted statistics below instead of recomputing the upstream plan
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        if cached is not None:
            cached.append(data)
    if series:
        if fit:
            cols = numeric_columns(data, exclude=keys)
            st.median_columns["medians_pre"] = cols
            st.tables["medians_pre"], some = series_medians(data, cols, series)
        cols = st.median_columns["medians_pre"]
        data = fill_by_series(data, st.tables["medians_pre"], cols, some if fit else cols, series, "0.0D")
    else:
        data, med_pre, zero = impute_pass1(data, keys, st, fit)
        if fit:
            st.medians_pre, st.zero_cols = med_pre, zero

    # 1. positional lags / rolling / differences, one shared window ordering
    if has_dt:
        data = add_row_index(data, "datetime", series)
    if add_lags and TARGET in data.columns and has_dt:
        data = halo_window(data, series,
                           lambda w: lag_sql(TARGET, w, spec.lags, spec.ma, spec.std, spec.diff),
                           back=spec.reach, sql=True)

    # 2-3. holiday and calendar features (one projection)
    if has_dt:
        data = with_is_holiday(data, "datetime", date_col="date")
        data = project(data, calendar_sql("datetime", spec.day_hour_flags))
    have = data.columns
    hs = set(have)

    # 4-6. interactions, cyclical encodings, one-hot weather, drops (one projection)
    new: dict[str, str] = {}
    if {"temp", "is_weekend"} <= hs:
        new["temp_weekend_interaction"] = "`temp` * `is_weekend`"
    if {"rain_1h", "is_rush_hour_am"} <= hs:
        new["rain_rush_hour_interaction"] = "`rain_1h` * `is_rush_hour_am`"
    hour_src = "hour_of_day" if "hour_of_day" in hs else ("hour" if "hour" in hs else None)
    for name, src, period in (("hour", hour_src, 24), ("day", "day", 31), ("month", "month", 12),
                              ("day_of_week", "day_of_week", 7)):
        if src and src in hs:
            new[f"{name}_sin"], new[f"{name}_cos"] = cyclical_sql(src, period)
    if "weather_main" in hs:
        if fit:
            counts = category_counts(data)
            st.weather_mode = mode_of(counts)
            # after the mode fill the category set is the same
            st.weather_categories = sorted(c for c, _ in counts)
        wm = f"coalesce(`weather_main`, {lit(st.weather_mode)})" if st.weather_mode is not None else "`weather_main`"
        if not fit and spec.one_hot == "frame":
            cats = distinct_categories(data.selectExpr(f"{wm} AS weather_main"))
        else:
            cats = st.weather_categories or []
        for c in cats:
            new[f"weather_{c}"] = f"coalesce(CAST(({wm} = {lit(c)}) AS INT), 0)"
    elif st.weather_categories:
        for c in st.weather_categories:
            new[f"weather_{c}"] = "0"
    drop = tuple(c for c in NON_FEATURE_COLUMNS if c != "datetime" and c in hs)
    data = project(data, new, drop=drop, columns=have)

    # 7. median fill of nulls left by the windows; all-null columns stay null
    feat_cols = [c for c in numeric_columns(data, exclude=keys)]
    if fit:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        if cached is not None:
            cached.append(data)
        if series:
            st.median_columns["medians_post"] = feat_cols
            st.tables["medians_post"], _ = series_medians(data, feat_cols, series)
        else:
            summ = summarize(data, feat_cols, [0.5])
            st.medians_post = {c: summ.quantiles[c][0] for c in feat_cols}
        st.feature_names = [c for c in feat_cols if c != TARGET]
    if series:
        cols = st.median_columns["medians_post"]
        data = fill_by_series(data, st.tables["medians_post"], cols, cols, series, "CAST(NULL AS DOUBLE)")
    schema = data.schema
    fills = {c: f"coalesce(CAST({q(c)} AS DOUBLE), {lit(float(v))})"
             for c, v in st.medians_post.items() if v is not None and c in schema.fieldNames()}
    non_numeric = tuple(f.name for f in schema.fields
                        if f.name not in keys and not isinstance(f.dataType, _NUMERIC))
    data = project(data, fills, drop=non_numeric + (() if keep_keys else (RN,)), columns=schema.fieldNames())
    return data, st


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
