"""Feature and target scaling (AG-12, ML-1, ML-2, FN-NU5).

sklearn semantics, written as Spark expressions:
* robust: (x − median) / (q3 − q1), a zero IQR scales by 1 (so rare 0/1 flags
  survive, unlike ``ml.feature.RobustScaler``);
* min-max: (y − min) / (max − min), a zero range scales by 1 (constant → 0).
Quartiles are exact (``exact_quantiles``) and fitted in one two-pass job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.functions.sqlexpr import lit, q
from hourcast.operators.quantiles import summarize, summarize_by
from hourcast.session import cut_lineage


@dataclass
class Scalers:
    features: list[str]
    target: str
    median: dict[str, float | None] = field(default_factory=dict)
    q1: dict[str, float | None] = field(default_factory=dict)
    q3: dict[str, float | None] = field(default_factory=dict)
    min_value: dict[str, float | None] = field(default_factory=dict)
    max_value: dict[str, float | None] = field(default_factory=dict)

    def robust_scale(self, c: str) -> float:
        q1, q3 = self.q1.get(c), self.q3.get(c)
        if q1 is None or q3 is None or q3 - q1 == 0:
            return 1.0
        return q3 - q1

    def target_range(self) -> float:
        lo, hi = self.min_value.get(self.target), self.max_value.get(self.target)
        if lo is None or hi is None or hi - lo == 0:
            return 1.0
        return hi - lo

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> "Scalers":
        return cls(**d)


def fit_scalers(df: DataFrame, features: Sequence[str], target: str) -> Scalers:
    cols = [*features, target]
    summ = summarize(df, cols, [0.25, 0.5, 0.75])
    s = Scalers(list(features), target)
    for c in cols:
        s.q1[c], s.median[c], s.q3[c] = summ.quantiles[c]
        s.min_value[c], s.max_value[c] = summ.min[c], summ.max[c]
    return s


#: Columns that rows scaled per series carry, so that a scaled target can be turned back.
LOW, RANGE = "_low", "_range"


@dataclass
class SeriesScalers:
    """Scalers fitted per series: a table ``(by…, median, scale, low, range)`` with a row per series, the
    first two arrays in the order of ``features``. A series without values of a column has a null there."""
    features: list[str]
    target: str
    by: list[str]
    table: DataFrame

    def to_dict(self) -> dict:
        return {"features": self.features, "target": self.target, "by": self.by}


def series_statistics(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str]) -> DataFrame:
    """``(by…, feature, median, q1, q3, robust_scale, min_value, max_value)``, a row per series and column."""
    cols = [*features, target]
    stats = summarize_by(df, cols, [0.25, 0.5, 0.75], list(by))
    iqr = F.col("q")[2] - F.col("q")[0]
    names = F.array(*[F.lit(c) for c in cols])
    return stats.select(*(q(c) for c in by), names[F.col("k")].alias("feature"), F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"),
                        F.col("q")[2].alias("q3"), F.when(iqr != 0, iqr).otherwise(F.lit(1.0)).alias("robust_scale"),
                        F.col("min").alias("min_value"), F.col("max").alias("max_value"), "k")


def fit_series_scalers(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str]) -> SeriesScalers:
    """Medians, quartile ranges and target ranges of every series, written to the shared folder."""
    keys = [q(c) for c in by]
    stats = series_statistics(df, features, target, by)
    n = len(features)
    ordered = F.array_sort(F.collect_list(F.when(F.col("k") < n, F.struct("k", "median", "robust_scale"))))
    span = F.col("max_value") - F.col("min_value")
    is_target = F.col("k") == n
    table = stats.groupBy(*keys).agg(
        ordered.alias("_f"), F.max(F.when(is_target, F.coalesce("min_value", F.lit(0.0)))).alias("low"),
        F.max(F.when(is_target, F.when(span != 0, span).otherwise(F.lit(1.0)))).alias("range"))
    table = table.select(*keys, F.col("_f.median").alias("median"), F.col("_f.robust_scale").alias("scale"), "low", "range")
    return SeriesScalers(list(features), target, list(by), cut_lineage(table))


def transform_series(df: DataFrame, s: SeriesScalers, keep: Sequence[str] = (), target_out: str | None = None) -> DataFrame:
    """``transform`` with the row's own series' parameters, and the columns ``LOW`` and ``RANGE``. Rows of a
    series that was not fitted have features 0 and an unscaled target."""
    have = set(df.columns)
    told = s.table.select(*(F.col(q(c)).alias(f"_s{i}") for i, c in enumerate(s.by)), F.col("median").alias("_median"),
                          F.col("scale").alias("_scale"), F.col("low").alias(LOW), F.col("range").alias(RANGE))
    on = F.lit(True)
    for i, c in enumerate(s.by):
        on = on & F.col(q(c)).eqNullSafe(F.col(f"_s{i}"))
    joined = df.join(told, on, "left")
    exprs = [q(k) for k in keep if k in have]
    for i, c in enumerate(s.features):
        x = f"CAST({q(c)} AS DOUBLE)" if c in have else "0.0D"
        exprs.append(f"coalesce(nanvl(({x} - _median[{i}]) / _scale[{i}], NULL), 0.0D) AS {q(c)}")
    exprs += [f"coalesce({LOW}, 0.0D) AS {LOW}", f"coalesce({RANGE}, 1.0D) AS {RANGE}"]
    if s.target in have:
        exprs.append(f"(CAST({q(s.target)} AS DOUBLE) - coalesce({LOW}, 0.0D)) / coalesce({RANGE}, 1.0D) AS {q(target_out or s.target)}")
    return joined.selectExpr(*exprs)


def unscale_target(c: Column, s: Scalers | SeriesScalers) -> Column:
    """A scaled target as trips; rows scaled per series bring their range along."""
    if isinstance(s, SeriesScalers):
        return c * F.col(RANGE) + F.col(LOW)
    lo = s.min_value.get(s.target) or 0.0
    return c * F.lit(s.target_range()) + F.lit(lo)


def transform(df: DataFrame, s: Scalers | SeriesScalers, keep: Sequence[str] = (), target_out: str | None = None) -> DataFrame:
    """Scaled features in training order (nulls → 0 = the training median) and scaled target. A training
    feature that ``df`` lacks counts as raw 0 and is scaled like any other value (PRJ-8); columns that
    training did not see are left out."""
    if isinstance(s, SeriesScalers):
        return transform_series(df, s, keep, target_out)
    have = set(df.columns)  # one schema round trip, then one selectExpr
    exprs = [q(k) for k in keep if k in have]
    for c in s.features:
        med = s.median.get(c)
        if med is None:
            exprs.append(f"0.0D AS {q(c)}")
            continue
        if c not in have:
            exprs.append(f"{lit(float((0.0 - med) / s.robust_scale(c)))} AS {q(c)}")
            continue
        x = f"((CAST({q(c)} AS DOUBLE) - {lit(float(med))}) / {lit(float(s.robust_scale(c)))})"
        exprs.append(f"coalesce(nanvl({x}, NULL), 0.0D) AS {q(c)}")
    if s.target in have:
        lo = s.min_value.get(s.target) or 0.0
        exprs.append(f"((CAST({q(s.target)} AS DOUBLE) - {lit(float(lo))}) / {lit(float(s.target_range()))}) "
                     f"AS {q(target_out or s.target)}")
    return df.selectExpr(*exprs)


VERSION = "model_version"


def serving_table(spark: SparkSession, versions: dict[str, Scalers]) -> DataFrame:
    """``(model_version, feature, position, median, scale)`` of several fitted models, written to the shared
    folder: the state that ``serve`` joins. A feature without a median has a null there."""
    rows = [(v, c, i, s.median.get(c), float(s.robust_scale(c))) for v, s in versions.items() for i, c in enumerate(s.features)]
    return cut_lineage(spark.createDataFrame(rows, f"{VERSION} string, feature string, position int, median double, scale double"))


def serve(df: DataFrame, table: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """``(model_version, keys…, features)``: every row's inputs for the model version it names, in that model's
    training order, in one plan for all versions (ML-11, PRJ-8).

    A training feature that ``df`` lacks counts as raw 0 and is scaled; a null is the training median, so 0;
    columns that the version was not trained on are left out, and rows of unknown versions too. One row per
    version meets the data by a join on the version."""
    values = [f for f in df.schema.fields if f.name not in {*keys, *ignore, VERSION} and isinstance(f.dataType, T.NumericType)]
    told = ", ".join(f"{lit(f.name)}, CAST({q(f.name)} AS DOUBLE)" for f in values)
    rows = df.selectExpr(VERSION, *map(q, keys), f"map({told}) AS _values" if told else "CAST(map() AS map<string,double>) AS _values")
    state = table.groupBy(VERSION).agg(F.array_sort(F.collect_list(F.struct("position", "feature", "median", "scale"))).alias("_state"))
    raw = "if(map_contains_key(_values, s.feature), _values[s.feature], 0.0D)"
    scaled = f"transform(_state, s -> coalesce(nanvl(({raw} - s.median) / s.scale, NULL), 0.0D))"
    return rows.join(state, VERSION).selectExpr(VERSION, *map(q, keys), f"{scaled} AS features")


def params_frame(spark: SparkSession, s: Scalers) -> DataFrame:
    """Fitted scaler parameters as a table (one row per column)."""
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("feature", T.StringType()), ("median", T.DoubleType()), ("q1", T.DoubleType()),
        ("q3", T.DoubleType()), ("robust_scale", T.DoubleType()), ("min_value", T.DoubleType()),
        ("max_value", T.DoubleType()))])
    rows = []
    for c in [*s.features, s.target]:
        rows.append((c, s.median.get(c), s.q1.get(c), s.q3.get(c), float(s.robust_scale(c)),
                     s.min_value.get(c), s.max_value.get(c)))
    return spark.createDataFrame(rows, schema)
