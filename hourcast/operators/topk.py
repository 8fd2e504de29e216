"""Sorts, limits and top-k (TK-1..8). Limits here are the feature itself
(a top-n report, the latest hours to score), never a way to cut work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_importance(imp: DataFrame, n: int = 15, feature: str = "feature",
                   importance: str = "importance") -> DataFrame:
    """Top n by importance descending, ties by name (TK-2, AN-2).
    ``orderBy().limit()`` plans as a per-partition top-n merge."""
    return (imp.orderBy(F.desc(importance), F.asc(feature)).limit(n)
            .withColumn("rank", F.row_number().over(Window.orderBy(F.desc(importance), F.asc(feature)))))


def last_n(df: DataFrame, n: int, series_cols: Sequence[str] = (), ts_col: str = "datetime") -> DataFrame:
    """The newest n rows of every series (TK-3), for scoring the latest window."""
    series = list(series_cols)
    if not series:
        return df.orderBy(F.desc(ts_col)).limit(n)
    w = Window.partitionBy(*series).orderBy(F.desc(ts_col))
    # rank-limited window: Spark plans a per-partition group limit before the shuffle
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def first_rows(df: DataFrame, n: int = 20, ts_col: str = "datetime") -> DataFrame:
    """The first n rows and the row at offset n (TK-4), with their position."""
    head = df.orderBy(F.asc_nulls_last(ts_col)).limit(n + 1)
    return head.withColumn("position", F.row_number().over(Window.orderBy(F.asc_nulls_last(ts_col))) - 1)
