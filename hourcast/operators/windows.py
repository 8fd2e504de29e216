"""Positional (row-based) windows per series that scale out even for one series
(WN-1..4 and the frame machinery behind WN-5..9).

The reference computes lags and rolling statistics on rows sorted by time.
A plain ``Window.orderBy(datetime)`` with no partition key sends the whole
series through one task (``Exchange SinglePartition``). Here every series is
cut into blocks of consecutive rows that are processed in parallel:

1. ``add_row_index`` gives each row its 1-based position ``_rn`` within its
   series. Rows are bucketed by week; per-(series, week) counts (a table of
   series × weeks rows) give prefix offsets; ``row_number`` runs inside each
   (series, week) partition. No global sort, no single partition over the data.
2. ``halo_window`` assigns row ``_rn`` to block ``(_rn-1) div B`` and copies the
   last ``back`` rows of a block into the next block and the first ``fwd`` rows
   into the previous one. A window partitioned by (series, block) and ordered
   by ``_rn`` then sees every row it needs for any lag ≤ ``back`` or lead ≤
   ``fwd``; only the block's own rows are kept. Each row is copied at most
   twice, so the cost is one extra shuffle of ≤ (1 + (back + fwd)/B) × rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourcast.functions.sqlexpr import project, q

RN = "_rn"
BLOCK = "_blk"
CORE = "_core"
_BUCKET = "_bkt"
_NULL_BUCKET = 2 ** 62
#: Rows without an order value lie in so many buckets, by a hash of the row.
_NULL_BUCKETS = 1024

WEEK_SECONDS = 7 * 24 * 3600
DEFAULT_BLOCK_ROWS = 8192


def add_row_index(df: DataFrame, order_col: str = "datetime", series_cols: Sequence[str] = (),
                  tiebreak: Sequence[str] = (), bucket_seconds: int = WEEK_SECONDS,
                  name: str = RN, bucket: Column | None = None) -> DataFrame:
    """1-based row position per series by ascending ``order_col`` (nulls last, in the order of a hash of
    the row and then of ``tiebreak``, so that many of them do not meet in one task).

    ``bucket`` may give any coarse key that is monotone in ``order_col``
    (default: weeks of a timestamp column)."""
    series = list(series_cols)
    ts = F.col(order_col)
    if bucket is None:
        bucket = F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(bucket_seconds))
    told = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = F.pmod(F.xxhash64(*told), F.lit(_NULL_BUCKETS)) + F.lit(_NULL_BUCKET)
    # never null to the optimiser either: the join below would else infer a filter on the hash of all columns,
    # and Spark's constraints double with every column of it that a projection underneath has made
    bucket = F.coalesce(bucket.cast("long"), spread, F.lit(_NULL_BUCKET))
    b = df.withColumn(_BUCKET, bucket)
    counts = b.groupBy(*series, _BUCKET).agg(F.count(F.lit(1)).alias("_cnt"))
    prior = Window.partitionBy(*series).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*series, _BUCKET,
                            F.coalesce(F.sum("_cnt").over(prior), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*series, _BUCKET).orderBy(
        F.asc_nulls_last(order_col), F.when(ts.isNull(), F.xxhash64(*told)), *[F.asc_nulls_last(t) for t in tiebreak])
    return (b.join(offsets, on=[*series, _BUCKET], how="inner")
            .withColumn(name, (F.col("_off") + F.row_number().over(within)).cast("long"))
            .drop(_BUCKET, "_off"))


def halo_window(df: DataFrame, series_cols: Sequence[str], columns: Callable[[Window], dict[str, Column]],
                back: int, fwd: int = 0, rn: str = RN, block_rows: int | None = None,
                sql: bool = False) -> DataFrame:
    """Add window columns computed over row frames reaching ``back`` rows back
    and ``fwd`` rows ahead, without a single-partition exchange.

    ``columns(w)`` returns ``{name: expr}`` built on the given ``WindowSpec``
    (``partitionBy(series, block).orderBy(_rn)``); frames are set by the caller
    with ``w.rowsBetween``. With ``sql=True`` the callback gets a ``SqlWindow``
    and returns SQL text (one ``selectExpr`` for wide outputs).
    """
    series = list(series_cols)
    bsz = block_rows or max(DEFAULT_BLOCK_ROWS, 4 * max(back, fwd, 1))
    if back > bsz or fwd > bsz:
        raise ValueError("block smaller than the window reach")
    pos = (F.col(rn) - 1) % bsz
    blk = F.floor((F.col(rn) - 1) / bsz)
    copies = F.filter(F.array(
        F.struct(blk.alias("b"), F.lit(True).alias("c")),
        F.when(pos >= bsz - back, F.struct((blk + 1).alias("b"), F.lit(False).alias("c"))),
        F.when((pos < fwd) & (blk > 0), F.struct((blk - 1).alias("b"), F.lit(False).alias("c"))),
    ), lambda x: x.isNotNull())
    exploded = (df.withColumn("_copy", F.explode(copies))
                .withColumn(BLOCK, F.col("_copy.b"))
                .withColumn(CORE, F.col("_copy.c"))
                .drop("_copy"))
    if sql:
        part = ", ".join([*[q(s) for s in series], BLOCK])
        spec = SqlWindow(f"PARTITION BY {part} ORDER BY {q(rn)}")
        out = project(exploded, columns(spec))
    else:
        w = Window.partitionBy(*series, BLOCK).orderBy(rn)
        out = exploded.withColumns(columns(w))
    return out.where(F.col(CORE)).drop(BLOCK, CORE)


class SqlWindow:
    """Window clause text for SQL-mode ``halo_window`` callbacks."""

    def __init__(self, spec: str):
        self.spec = spec

    def over(self, frame: tuple[int, int] | None = None) -> str:
        if frame is None:
            return f"OVER ({self.spec})"
        lo, hi = frame
        fmt = lambda x: "CURRENT ROW" if x == 0 else (f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING")
        return f"OVER ({self.spec} ROWS BETWEEN {fmt(lo)} AND {fmt(hi)})"


def lag_sql(value: str, w: SqlWindow, lags: Sequence[int], ma: Sequence[int], std: Sequence[int],
            diff: Sequence[int]) -> dict[str, str]:
    """SQL-text form of ``lag_columns`` (WN-1..4)."""
    v = q(value)
    out: dict[str, str] = {}
    for k in lags:
        out[f"{value}_lag_{k}"] = f"lag({v}, {k}) {w.over()}"
    for n, fn, tag in [*[(n, "avg", "ma") for n in ma], *[(n, "stddev_samp", "std") for n in std]]:
        fr = w.over((-(n - 1), 0))
        out[f"{value}_{tag}_{n}h"] = f"CASE WHEN count({v}) {fr} = {n} THEN {fn}({v}) {fr} END"
    for k in diff:
        out[f"{value}_diff_{k}"] = f"{v} - lag({v}, {k}) {w.over()}"
    return out


def full_frame(w: Window, n: int) -> Window:
    """Trailing frame of n rows including the current one."""
    return w.rowsBetween(-(n - 1), 0)


def rolling(c: Column, w: Window, n: int, fn) -> Column:
    """fn over the last n rows, null until n non-null values exist
    (pandas ``rolling(window=n)`` with the default min_periods = n)."""
    frame = full_frame(w, n)
    return F.when(F.count(c).over(frame) == n, fn(c).over(frame))


def lag_columns(value: str, w: Window, lags: Sequence[int], ma: Sequence[int], std: Sequence[int],
                diff: Sequence[int]) -> dict[str, Column]:
    """Lag / rolling mean / rolling std / difference columns (WN-1..4)."""
    v = F.col(value)
    out: dict[str, Column] = {}
    for k in lags:
        out[f"{value}_lag_{k}"] = F.lag(v, k).over(w)
    for n in ma:
        out[f"{value}_ma_{n}h"] = rolling(v, w, n, F.avg)
    for n in std:
        out[f"{value}_std_{n}h"] = rolling(v, w, n, F.stddev_samp)
    for k in diff:
        out[f"{value}_diff_{k}"] = v - F.lag(v, k).over(w)
    return out


def window_reach(lags=(), ma=(), std=(), diff=()) -> int:
    return max([0, *lags, *[n - 1 for n in ma], *[n - 1 for n in std], *diff])
