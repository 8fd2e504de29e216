"""Sliding sequences, targets and the chronological split
(WN-5..9, FLT-3, FN-NU6, ML-3, TK-6).

A sequence is the array of the last L feature rows (``collect_list`` over a
row frame) and its target the value H rows ahead (``lead``). Frames run on the
block/halo windows of ``operators.windows``, so even one long series is built
by many tasks; each row's array holds L × F doubles, the same size a model
input needs anyway.

Eligible last rows (n rows per series, rn 1-based), as in the reference:
* ``fixed``: rn ∈ [L, n − H − 1], target rn + H (the newest row is never a
  target); ``include_last=True`` extends to n − H;
* ``next``:  rn ∈ [L, n − 1], target rn + 1;
* ``multi``: rn ∈ [L, n − H], targets rn + 1 … rn + H.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourcast.operators.windows import RN, add_row_index, halo_window

SEQ = "seq"
TARGET = "target"
TARGETS = "targets"


def fill_with_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Last-resort null → column mean before sequencing (FN-NU6)."""
    row = df.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in cols]).first()
    repl = {c: F.coalesce(F.col(f"`{c}`"), F.lit(row[c])) for c in cols if row[c] is not None}
    return df.withColumns(repl) if repl else df


def build_sequences(df: DataFrame, feature_cols: Sequence[str], target_col: str, L: int, H: int,
                    series_cols: Sequence[str] = (), mode: str = "fixed", include_last: bool = False,
                    flatten: bool = True, keep: Sequence[str] = ("datetime",)) -> DataFrame:
    """Rows ``(series…, keep…, _rn, seq, target | targets)`` for every eligible
    sequence without nulls (FLT-3). ``df`` must carry ``_rn`` (``add_row_index``).

    ``seq`` is ``array<array<double>>`` (L × F) or, with ``flatten``, the
    row-major ``array<double>`` a model consumes.
    """
    series = list(series_cols)
    from hourcast.functions.sqlexpr import q

    y = F.col(f"`{target_col}`").cast("double")
    row = F.expr("array(" + ", ".join(f"CAST({q(c)} AS DOUBLE)" for c in feature_cols) + ")")
    fwd = H + 1 if mode == "fixed" else H

    def cols(w: Window):
        frame = w.rowsBetween(-(L - 1), 0)
        out = {SEQ: F.collect_list(row).over(frame)}
        if mode == "multi":
            out[TARGETS] = F.collect_list(y).over(w.rowsBetween(1, H))
            out["_end_ok"] = F.lit(True)
        else:
            h = 1 if mode == "next" else H
            out[TARGET] = F.lead(y, h).over(w)
            limit = h + 1 if (mode == "fixed" and not include_last) else h
            out["_end_ok"] = F.lead(F.lit(1), limit).over(w).isNotNull()
        return out

    have = set(df.columns)
    keep = [k for k in keep if k in have]
    needed = []
    for c in [*series, *keep, RN, *feature_cols, target_col]:
        if c not in needed:
            needed.append(c)
    base = df.select(*[F.col(f"`{c}`") for c in needed])
    out = halo_window(base, series, cols, back=L - 1, fwd=fwd)
    ok = (F.size(SEQ) == L) & F.col("_end_ok")
    ok = ok & ~F.exists(F.flatten(F.col(SEQ)), lambda v: v.isNull() | F.isnan(v))
    if mode == "multi":
        ok = ok & (F.size(TARGETS) == H) & ~F.exists(F.col(TARGETS), lambda v: v.isNull())
        tgt = [F.col(TARGETS)]
    else:
        ok = ok & F.col(TARGET).isNotNull()
        tgt = [F.col(TARGET)]
    seq = F.flatten(F.col(SEQ)) if flatten else F.col(SEQ)
    return out.where(ok).select(*series, *keep, RN, seq.alias(SEQ), *tgt)


def windows_before(df: DataFrame, value_cols: Sequence[str], L: int, series_cols: Sequence[str] = (),
                   keep: Sequence[str] = ("datetime",)) -> DataFrame:
    """``(series…, keep…, _rn, seq)``: the L rows before every row that has so many (WN-9). Over history and
    forecast rows together, a forecast row's window holds the newest history and the forecast before it."""
    from hourcast.functions.sqlexpr import q

    row = F.expr("array(" + ", ".join(f"CAST({q(c)} AS DOUBLE)" for c in value_cols) + ")")
    base = df.select(*series_cols, *keep, RN, row.alias("_row"))
    out = halo_window(base, list(series_cols), lambda w: {SEQ: F.collect_list("_row").over(w.rowsBetween(-L, -1))}, back=L)
    return out.where(F.size(SEQ) == L).drop("_row")


def sequence_columns(seq_df: DataFrame, L: int, prefix: str = "x") -> DataFrame:
    """Single-feature sequences as columns x_0 … x_{L−1} (oldest first)."""
    inner = F.col(SEQ)
    first = seq_df.schema[SEQ].dataType.elementType
    if hasattr(first, "elementType"):
        inner = F.flatten(inner)
    return seq_df.select(*[c for c in seq_df.columns if c != SEQ],
                         *[inner[i].alias(f"{prefix}_{i}") for i in range(L)])


def multi_step_targets(df: DataFrame, target_col: str, H: int, series_cols: Sequence[str] = (),
                       keep: Sequence[str] = ("datetime",)) -> DataFrame:
    """Targets 1…H rows ahead as columns ``target_1..H`` for rows that have all
    of them (WN-8)."""
    series = list(series_cols)
    y = F.col(target_col).cast("double")
    out = halo_window(df, series, lambda w: {TARGETS: F.collect_list(y).over(w.rowsBetween(1, H))},
                      back=0, fwd=H)
    return out.where(F.size(TARGETS) == H).select(
        *series, *[k for k in keep if k in df.columns], RN,
        *[F.col(TARGETS)[i].alias(f"target_{i + 1}") for i in range(H)])


def split_sizes(n: int, test_size: float = 0.2, val_size: float = 0.25) -> tuple[int, int, int]:
    """sklearn ``train_test_split(shuffle=False)`` applied twice."""
    n_test = math.ceil(test_size * n)
    rest = n - n_test
    n_val = math.ceil(val_size * rest)
    return rest - n_val, n_val, n_test


def chronological_split(seq_df: DataFrame, series_cols: Sequence[str] = (), test_size: float = 0.2,
                        val_size: float = 0.25, order_col: str = "datetime") -> DataFrame:
    """Label each sequence ``train`` / ``val`` / ``test`` by time (ML-3, TK-6).

    Sizes follow sklearn: n_test = ⌈0.2·n⌉, n_val = ⌈0.25·(n − n_test)⌉ per
    series. The per-series counts are a tiny aggregate joined back.
    """
    series = list(series_cols)
    idx = add_row_index(seq_df, order_col, series, name="seq_index")
    counts = seq_df.groupBy(*series).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    n_test = F.ceil(n * F.lit(test_size))
    rest = n - n_test
    n_val = F.ceil(rest * F.lit(val_size))
    i = F.col("seq_index")
    label = F.when(i <= rest - n_val, F.lit("train")).when(i <= rest, F.lit("val")).otherwise(F.lit("test"))
    if series:
        # one row per series: AQE broadcasts it when small, shuffles otherwise
        joined = idx.join(counts, on=series, how="inner")
    else:
        joined = idx.withColumn("_one", F.lit(1)).join(
            F.broadcast(counts.withColumn("_one", F.lit(1))), on="_one").drop("_one")
    return joined.withColumn("split", label).drop("_n")
