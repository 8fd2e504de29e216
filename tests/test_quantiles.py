import numpy as np

from hourcast.operators.quantiles import exact_quantiles, summarize


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    n = 20000
    a = np.round(rng.normal(size=n), 2)          # many duplicates
    b = rng.exponential(size=n)
    b[rng.random(n) < 0.1] = np.nan              # nulls
    rows = [(float(x), None if np.isnan(y) else float(y), 5.0) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["a", "b", "c"], probs)
    np.testing.assert_allclose(got["a"], np.percentile(a, [p * 100 for p in probs]), rtol=1e-12)
    np.testing.assert_allclose(got["b"], np.nanpercentile(b, [p * 100 for p in probs]), rtol=1e-12)
    assert got["c"] == [5.0] * 5


def test_summary_counts_and_all_null(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "x double, y double")
    s = summarize(df, ["x", "y"], [0.5])
    assert s.nulls == {"x": 1, "y": 3} and s.count["x"] == 2
    assert s.quantiles["x"] == [2.0] and s.quantiles["y"] == [None]
    assert s.min["x"] == 1.0 and s.max["x"] == 3.0


def test_tied_values_are_not_gathered(spark, monkeypatch):
    """A flag that is mostly zero: one bracket value, or one row per quantile, comes to the driver."""
    from pyspark.sql import DataFrame

    df = spark.range(40000).selectExpr("if(id % 20 = 0, 1.0D, 0.0D) AS flag", "if(id % 4 = 0, id % 7, 0) AS rain",
                                       "cast(id AS double) AS id")
    sizes = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: (lambda rows: (sizes.append(len(rows)), rows)[1])(collect(self)))
    probs = [0.25, 0.5, 0.75, 0.95]
    got = exact_quantiles(df, ["flag", "rain", "id"], probs)
    assert isinstance(df, DataFrame) and len(sizes) == 2 and max(sizes) <= 3 * len(probs)
    pdf = df.toPandas()
    for c in got:
        np.testing.assert_allclose(got[c], np.quantile(pdf[c], probs))


def test_quantiles_between_two_ranks(spark):
    """674 values, two neighbours around the third quartile: interpolated, not the upper one."""
    values = [17.0] * 505 + [18.0] * 169
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_quantiles(df, ["x"], [0.75])["x"] == [np.quantile(values, 0.75)] == [17.75]


def grouped(rows, by):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[c] for c in by), []).append(r)
    return out


def test_quantiles_of_groups(spark):
    from hourcast.operators.quantiles import summarize_by

    rng = np.random.default_rng(8)
    rows = [("big", i % 2, float(np.round(x, 2)), None if i % 9 == 0 else float(i % 13)) for i, x in enumerate(rng.normal(size=30_000))]
    rows += [(None, 1, float(i), None) for i in range(7)] + [("one", None, 2.5, 4.0), ("none", 0, None, None)]
    df = spark.createDataFrame(rows, "a string, b int, x double, y double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["a"], r["b"], r["k"]): r for r in summarize_by(df, ["x", "y"], probs, ["a", "b"]).collect()}
    groups = grouped([dict(zip(("a", "b", "x", "y"), r)) for r in rows], ["a", "b"])
    assert len(got) == 2 * len(groups)
    for key, members in groups.items():
        for k, c in enumerate(("x", "y")):
            values = [m[c] for m in members if m[c] is not None]
            r = got[(*key, k)]
            assert (r["n"], r["nulls"]) == (len(values), len(members) - len(values))
            if values:
                assert (r["min"], r["max"]) == (min(values), max(values))
                np.testing.assert_allclose(r["q"], np.quantile(values, probs), rtol=1e-12)
            else:
                assert r["q"] is None and r["min"] is None


def test_group_brackets_are_not_broadcast(spark):
    """The brackets grow with the number of groups: the plan holds no forced broadcast and no nested loop."""
    from hourcast.operators.quantiles import summarize_by

    df = spark.range(1000).selectExpr("id % 7 AS g", "id * 1.0D AS x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = summarize_by(df, ["x"], [0.5], ["g"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan and "CartesianProduct" not in plan
