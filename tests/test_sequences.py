import numpy as np
from pyspark.sql import functions as F

from hourcast.operators.sequences import (build_sequences, chronological_split, multi_step_targets,
                                          split_sizes)
from hourcast.operators.windows import add_row_index


def _indexed(spark, hourly_fixture):
    df = spark.createDataFrame(hourly_fixture[["datetime", "trip_count", "temp"]])
    return add_row_index(df, "datetime")


def test_sequence_counts(spark, hourly_fixture):
    df = _indexed(spark, hourly_fixture)
    n, L = 100, 6
    assert build_sequences(df, ["trip_count", "temp"], "trip_count", L, 2).count() == n - L - 2   # 92
    assert build_sequences(df, ["trip_count"], "trip_count", L, 1, mode="next").count() == n - L
    assert build_sequences(df, ["trip_count"], "trip_count", L, 3, mode="multi").count() == n - L - 3 + 1
    assert build_sequences(df, ["trip_count"], "trip_count", L, 2, include_last=True).count() == n - L - 2 + 1


def test_sequence_contents(spark, hourly_fixture):
    df = _indexed(spark, hourly_fixture)
    L, H = 6, 2
    seq = build_sequences(df, ["trip_count", "temp"], "trip_count", L, H, flatten=True).orderBy("_rn").first()
    y, t = hourly_fixture["trip_count"].values, hourly_fixture["temp"].values
    exp = np.column_stack([y[:L], t[:L]]).ravel()
    np.testing.assert_allclose(seq["seq"], exp)
    assert seq["target"] == y[L - 1 + H]


def test_multi_step_and_split(spark, hourly_fixture):
    df = _indexed(spark, hourly_fixture)
    ms = multi_step_targets(df, "trip_count", 3).orderBy("_rn").first()
    y = hourly_fixture["trip_count"].values
    assert [ms["target_1"], ms["target_2"], ms["target_3"]] == [y[1], y[2], y[3]]
    seqs = build_sequences(df, ["trip_count"], "trip_count", 6, 2)
    split = chronological_split(seqs).groupBy("split").count().collect()
    got = {r["split"]: r["count"] for r in split}
    tr, va, te = split_sizes(92)
    assert got == {"train": tr, "val": va, "test": te} and (tr, va, te) == (54, 19, 19)
    # the split is chronological: every test row is later than every train row
    lab = chronological_split(seqs)
    last_train = lab.where("split = 'train'").agg(F.max("datetime")).first()[0]
    first_test = lab.where("split = 'test'").agg(F.min("datetime")).first()[0]
    assert last_train < first_test
