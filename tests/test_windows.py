import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hourcast.operators.windows import RN, add_row_index, halo_window, lag_columns


def _frame(spark, n=300, series=("a", "b")):
    rng = np.random.default_rng(1)
    rows = []
    for s in series:
        ts = pd.date_range("2024-01-01", periods=n, freq="h")
        keep = rng.random(n) > 0.2  # gaps: positional, not hourly
        for t, v in zip(ts[keep], rng.integers(0, 50, keep.sum())):
            rows.append((s, t.to_pydatetime(), int(v)))
    return spark.createDataFrame(rows, "s string, datetime timestamp_ntz, y long")


def test_row_index_is_dense_per_series(spark):
    df = add_row_index(_frame(spark), "datetime", ["s"], bucket_seconds=3600 * 5)
    pdf = df.toPandas().sort_values(["s", "datetime"])
    for _, g in pdf.groupby("s"):
        assert list(g[RN]) == list(range(1, len(g) + 1))


def test_halo_blocks_match_a_plain_window(spark):
    df = add_row_index(_frame(spark), "datetime", ["s"])
    lags, ma, std, diff = (1, 3, 7), (2, 5), (3, 6), (1, 4)
    out = halo_window(df, ["s"], lambda w: lag_columns("y", w, lags, ma, std, diff),
                      back=7, block_rows=16)  # many small blocks
    got = out.toPandas().sort_values(["s", "datetime"]).reset_index(drop=True)
    exp = got[["s", "datetime", "y"]].copy()
    for _, idx in exp.groupby("s").groups.items():
        y = exp.loc[idx, "y"].astype(float)
        for k in lags:
            exp.loc[idx, f"y_lag_{k}"] = y.shift(k)
        for n in ma:
            exp.loc[idx, f"y_ma_{n}h"] = y.rolling(n).mean()
        for n in std:
            exp.loc[idx, f"y_std_{n}h"] = y.rolling(n).std()
        for k in diff:
            exp.loc[idx, f"y_diff_{k}"] = y.diff(k)
    for c in exp.columns[3:]:
        np.testing.assert_allclose(got[c].astype(float), exp[c].astype(float), rtol=1e-9, equal_nan=True)
    assert len(got) == df.count()


def test_lead_across_blocks(spark):
    df = add_row_index(_frame(spark, n=80, series=("a",)), "datetime")
    out = halo_window(df, [], lambda w: {"nxt": F.lead("y", 3).over(w)}, back=0, fwd=3, block_rows=8)
    pdf = out.toPandas().sort_values(RN)
    np.testing.assert_array_equal(pdf["nxt"].fillna(-1).values, pdf["y"].shift(-3).fillna(-1).values)


def test_many_rows_without_a_time_are_spread(spark):
    """Half of all stamps null: positions stay 1…n with nulls last, and no bucket holds many of them."""
    rows = spark.range(20_000).selectExpr("id", "id % 2 AS s", "CASE WHEN id % 4 < 2 THEN timestamp_seconds(id * 3600) END AS datetime")
    rows = rows.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    out = add_row_index(rows, "datetime", ["s"])
    got = out.groupBy("s").agg(F.count("*").alias("n"), F.countDistinct(RN).alias("d"), F.min(RN).alias("lo"), F.max(RN).alias("hi"),
                               F.max(F.when(F.col("datetime").isNotNull(), F.col(RN))).alias("last_time")).collect()
    assert all((r["n"], r["d"], r["lo"], r["hi"], r["last_time"]) == (10_000, 10_000, 1, 10_000, 5_000) for r in got)
    late = {r["id"]: r[RN] for r in out.where("datetime is null").collect()}
    assert late == {r["id"]: r[RN] for r in add_row_index(rows.repartition(3), "datetime", ["s"]).where("datetime is null").collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" in plan and "SinglePartition" not in plan


def test_one_bad_date_makes_blocks_not_one_array(spark):
    from hourcast.operators.aggregate import GRID, fill_hour_gaps, hour_grid

    span = spark.sql("SELECT 'a' AS s, TIMESTAMP_NTZ'0001-01-01 00:00:00' AS _lo, TIMESTAMP_NTZ'2024-01-01 05:00:00' AS _hi "
                     "UNION ALL SELECT 'b', TIMESTAMP_NTZ'2024-01-01 05:00:00', TIMESTAMP_NTZ'2024-01-01 05:00:00' UNION ALL SELECT 'c', NULL, NULL")
    got = {r["s"]: (r["n"], r["lo"], r["hi"], r["d"]) for r in hour_grid(span, ["s"]).groupBy("s").agg(
        F.count("*").alias("n"), F.min("datetime").cast("string").alias("lo"), F.max("datetime").cast("string").alias("hi"), F.approx_count_distinct("datetime").alias("d")).collect()}
    n = spark.sql("SELECT timestampdiff(HOUR, TIMESTAMP_NTZ'0001-01-01 00:00:00', TIMESTAMP_NTZ'2024-01-01 05:00:00') + 1 AS n").first()["n"]
    assert got["a"][:3] == (n, "0001-01-01 00:00:00", "2024-01-01 05:00:00") and got["b"][0] == 1 and "c" not in got
    # around the edge of a block
    hours = spark.sql(f"SELECT TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT), 0, 0) AS datetime, 1 AS trip_count FROM range({GRID + 5}) WHERE id IN (0, {GRID - 1}, {GRID + 4})")
    dense = fill_hour_gaps(hours).collect()
    assert len(dense) == GRID + 5 == len({r["datetime"] for r in dense}) and sum(r["trip_count"] for r in dense) == 3


def test_row_index_join_infers_no_filter_on_the_hash_of_all_columns(spark, capsys):
    """Such a filter, pushed below a projection that fills columns, doubles Spark's constraints with every column."""
    wide = spark.range(50).selectExpr("id AS s", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS datetime",
                                      *(f"nullif(id, {i}) AS c{i}" for i in range(30)))
    filled = wide.selectExpr("s", "datetime", *(f"coalesce(CAST(c{i} AS DOUBLE), 0.5D) AS c{i}" for i in range(30)))
    out = add_row_index(filled, "datetime", ["s"])
    capsys.readouterr()
    out.explain()
    assert not [x for x in capsys.readouterr().out.split("\n") if "Filter" in x and "xxhash64" in x]
    assert out.count() == 50
