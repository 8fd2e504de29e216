"""Permutation importance of linear models in closed form (AN-1).

Permuting the slice of feature f changes a linear prediction by the difference
of two numbers, the slice's weighted sum in the donor and in the sample itself.
So no perturbed copy is built and no model is scored: a sample becomes one
number per feature, and the numbers move once.

The permutation of a feature puts the samples in the order of an md5 key over
(seed, feature, sample); every sample receives the slice of the sample before
it, the first one that of the last. Any engine with md5 finds the same order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourcast.functions.sqlexpr import lit, q
from hourcast.operators.windows import add_row_index


def slice_sums(seq: str, weights: Sequence[float], n_features: int) -> str:
    """SQL text: array of the weighted sum of every feature's slice of a row-major sequence."""
    w = f"array({', '.join(f'{float(x)!r}D' for x in weights)})"
    steps = len(weights) // n_features
    at = f"t * {n_features} + f"
    return (f"transform(sequence(0, {n_features - 1}), f -> aggregate(sequence(0, {steps - 1}), 0.0D, "
            f"(s, t) -> s + {q(seq)}[{at}] * {w}[{at}]))")


def linear_importance(samples: DataFrame, seq: str, weights: Sequence[float], features: Sequence[str],
                      ids: Sequence[str], seed: int = 42) -> DataFrame:
    """``(feature, importance)``: mean absolute change of the prediction when a feature's slices are permuted
    over the samples. ``ids`` name a sample; a null id column counts as the empty text."""
    names = f"array({', '.join(map(lit, features))})"
    parts = ", ".join(f"coalesce(CAST({q(c)} AS STRING), '')" for c in ids)
    long = samples.selectExpr(f"concat_ws('|', {parts}) AS _sid", f"posexplode({slice_sums(seq, weights, len(features))}) AS (_f, _s)")
    long = long.selectExpr("_f", "_s", "_sid", f"md5(concat_ws('|', '{int(seed)}', {names}[_f], _sid)) AS _key")
    # positions under the key, counted in 4,096 pieces per feature
    ranked = add_row_index(long, "_key", ["_f"], tiebreak=["_sid"], name="_r", bucket=F.conv(F.substring("_key", 1, 3), 16, 10).cast("long"))
    n = samples.count()
    donors = ranked.select("_f", F.col("_s").alias("_from"), (F.col("_r") % F.lit(n) + 1).alias("_r"))
    moved = ranked.select("_f", "_s", "_r").join(donors, ["_f", "_r"])
    out = moved.groupBy("_f").agg(F.avg(F.abs(F.col("_from") - F.col("_s"))).alias("importance"))
    return out.select(F.expr(names)[F.col("_f")].alias("feature"), "importance")
