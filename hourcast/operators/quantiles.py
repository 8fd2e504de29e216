"""Exact, linearly interpolated column quantiles (AG-5, AG-12) that never put a
whole column into one task.

Spark's exact ``percentile`` merges a map of every distinct value into the
single final task of a global aggregate. Instead:

1. the columns are turned long — ``(k, v)`` rows, one per column and input
   row — so every statistic is a ``groupBy(k)`` with a few aggregate
   expressions (small generated code however many columns there are; the
   map-side partial aggregation sends one row per column and task);
2. one pass computes count, nulls, min, max and a ``percentile_approx``
   bracket [p − 3ε, p + 3ε] per column and probability (mergeable sketches,
   rank error ≤ ε·n, so the bracket holds the exact order statistics as soon as
   it is two ranks wide; up to 1/ε values, all of them are the bracket);
   a bracket of one value is the answer;
3. a second pass counts the distinct values inside the other brackets, with all
   values below a bracket as one group, and sums the counts in order; equal
   values cost one row, and about 6ε·n distinct values at most meet in a window;
4. the two order statistics of each quantile are picked in the cluster — one row
   per column and probability comes to the driver — and interpolated linearly as
   numpy / pandas / sklearn / DuckDB ``quantile_cont`` do.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourcast.functions.sqlexpr import q

#: 1 / ε of the sketches, the same for every row count.
ACCURACY = 10_000


def value_pairs(cols: list[str]) -> str:
    return ", ".join(f"named_struct('k', {i}, 'v', CAST({q(c)} AS DOUBLE))" for i, c in enumerate(cols))


def long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(k, v)``: column index and value as double, one row per column and row."""
    return df.selectExpr(f"inline(array({value_pairs(cols)}))")


@dataclass
class ColumnSummary:
    count: dict[str, int]
    nulls: dict[str, int]
    min: dict[str, float | None]
    max: dict[str, float | None]
    quantiles: dict[str, list[float | None]]


def summarize(df: DataFrame, cols: list[str], probs: list[float]) -> ColumnSummary:
    """Count, nulls, min, max and exact quantiles of every column (two passes)."""
    if not cols:
        return ColumnSummary({}, {}, {}, {}, {})
    lv = long_values(df, cols)
    v = F.col("v")
    aggs = [F.count("v").alias("n"), F.count_if(v.isNull()).alias("z"), F.min("v").alias("mn"), F.max("v").alias("mx")]
    if probs:
        delta = 3.0 / ACCURACY
        bounds = [b for p in probs for b in (max(0.0, p - delta), min(1.0, p + delta))]
        aggs.append(F.percentile_approx("v", F.array(*[F.lit(b) for b in bounds]), ACCURACY).alias("b"))
    first = {r["k"]: r for r in lv.groupBy("k").agg(*aggs).collect()}

    # an empty table has no row in ``first`` at all
    out = ColumnSummary(
        {c: int(first[i]["n"]) if first else 0 for i, c in enumerate(cols)},
        {c: int(first[i]["z"]) if first else 0 for i, c in enumerate(cols)},
        {c: first[i]["mn"] if first else None for i, c in enumerate(cols)},
        {c: first[i]["mx"] if first else None for i, c in enumerate(cols)},
        {c: [None] * len(probs) for c in cols})
    brackets = []
    for i, r in first.items():
        for j, p in enumerate(probs if r["n"] else ()):
            lo, hi, rank = r["b"][2 * j], r["b"][2 * j + 1], p * (r["n"] - 1)
            if r["n"] <= ACCURACY:  # fewer ranks than a bracket is wide: all values
                lo, hi = r["mn"], r["mx"]
            if lo == hi:
                out.quantiles[cols[i]][j] = lo
            else:
                brackets.append((i, j, lo, hi, math.floor(rank), math.ceil(rank), rank - math.floor(rank)))
    if not brackets:
        return out
    # bracket table: ≤ columns × probabilities rows, broadcast by construction
    br = df.sparkSession.createDataFrame(brackets, "k int, j int, lo double, hi double, r0 long, r1 long, part double")
    inside = lv.join(F.broadcast(br), "k").where(v <= F.col("hi"))
    counts = inside.groupBy("k", "j", "r0", "r1", "part", (v < F.col("lo")).alias("under"),
                            F.when(v >= F.col("lo"), v).alias("v")).count()
    upto = F.sum("count").over(Window.partitionBy("k", "j").orderBy(F.desc("under"), "v"))
    picked = (counts.withColumn("upto", upto).where(~F.col("under")).groupBy("k", "j", "part")
              .agg(F.min(F.when(F.col("upto") > F.col("r0"), v)).alias("a"), F.min(F.when(F.col("upto") > F.col("r1"), v)).alias("b")))
    for r in picked.collect():
        out.quantiles[cols[r["k"]]][r["j"]] = r["a"] + r["part"] * (r["b"] - r["a"])
    return out


def same_keys(a: str, b: str, keys: list[str]) -> Column:
    """Join condition: equal group keys, nulls together."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{q(k)}").eqNullSafe(F.col(f"{b}.{q(k)}"))
    return on


def summarize_by(df: DataFrame, cols: list[str], probs: list[float], by: list[str]) -> DataFrame:
    """The same per group: ``(by…, k, n, nulls, min, max, q)``, a row per group and column, where ``k`` is
    the column's position in ``cols`` (group columns have other names than these) and ``q`` holds the exact quantiles in the order of ``probs``.

    Nothing comes to the driver. The brackets are a table of groups × columns × probabilities rows and
    are joined on the group, whose number is not bounded; a group of any size is counted by partial
    aggregates, and only the distinct values inside one bracket meet in a window.
    """
    keys = [*(q(c) for c in by), "k"]
    lv = df.selectExpr(*keys[:-1], f"inline(array({value_pairs(cols)})) AS (k, _v)")
    delta = 3.0 / ACCURACY
    bounds = [b for p in probs for b in (max(0.0, p - delta), min(1.0, p + delta))]
    stats = lv.groupBy(*keys).agg(
        F.count("_v").alias("n"), F.count_if(F.col("_v").isNull()).alias("nulls"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.percentile_approx("_v", F.array(*[F.lit(b) for b in bounds]), ACCURACY).alias("_b"))
    # groups with fewer ranks than a bracket is wide take all values
    some = f"n <= {ACCURACY}"
    at = f"struct(j, if({some}, min, _b[2 * j]), if({some}, max, _b[2 * j + 1]), element_at(_probs, j + 1) * (n - 1))"
    listed = F.expr(f"array({', '.join(f'{float(p)!r}D' for p in probs)})")
    brackets = stats.where("n > 0").withColumn("_probs", listed).selectExpr(
        *keys, f"inline(transform(sequence(0, {len(probs) - 1}), j -> {at})) AS (_j, _lo, _hi, _rank)")
    on = same_keys("_l", "_r", [*by, "k"]) & (F.col("_l._v") <= F.col("_r._hi"))
    inside = lv.alias("_l").join(brackets.where("_lo < _hi").alias("_r"), on)
    counts = (inside.selectExpr(*(f"_l.{c}" for c in keys), "_j", "_rank", "_v < _lo AS _under", "CASE WHEN _v >= _lo THEN _v END AS _v")
              .groupBy(*keys, "_j", "_rank", "_under", "_v").agg(F.count(F.lit(1)).alias("_c")))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_j").orderBy(F.desc("_under"), "_v"))
    picked = (counts.withColumn("_upto", upto).where("not _under").groupBy(*keys, "_j", "_rank")
              .agg(F.expr("min(CASE WHEN _upto > floor(_rank) THEN _v END)").alias("_x"), F.expr("min(CASE WHEN _upto > ceil(_rank) THEN _v END)").alias("_y")))
    found = picked.selectExpr(*keys, "_j", "_x + (_rank - floor(_rank)) * (_y - _x) AS _v").unionByName(
        brackets.where("_lo = _hi").selectExpr(*keys, "_j", "_lo AS _v"))
    found = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_j", "_v"))).alias("_q"))
    out = stats.drop("_b").alias("_l").join(found.alias("_r"), same_keys("_l", "_r", [*by, "k"]), "left")
    return out.select(*(F.col(f"_l.{c}") for c in keys), "n", "nulls", "min", "max", F.col("_q._v").alias("q"))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    return summarize(df, cols, probs).quantiles


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Column medians ignoring nulls (pandas ``median`` after NaN → null)."""
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}
