from hourcast.operators.scaling import fit_scalers, transform, unscale_target
from pyspark.sql import functions as F


def test_robust_and_minmax_edges(spark):
    rows = [(float(i), 1.0 if i == 3 else 0.0, 7.0, float(10 * i)) for i in range(8)]
    df = spark.createDataFrame(rows, "x double, flag double, const double, y double")
    s = fit_scalers(df, ["x", "flag", "const"], "y")
    assert s.robust_scale("flag") == 1.0 and s.robust_scale("const") == 1.0
    assert s.robust_scale("x") == 3.5 and s.median["x"] == 3.5
    out = {r["x"]: r for r in transform(df, s, keep=["x"]).collect()} if False else None
    t = transform(df.withColumn("orig", F.col("x")), s, keep=["orig"]).collect()
    r3 = [r for r in t if r["orig"] == 3.0][0]
    assert r3["flag"] == 1.0 and r3["const"] == 0.0 and abs(r3["x"] - (-0.5 / 3.5)) < 1e-12
    assert min(r["y"] for r in t) == 0.0 and max(r["y"] for r in t) == 1.0
    back = df.select(unscale_target(F.lit(0.5), s).alias("v")).first()["v"]
    assert back == 35.0
    c = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0)], "x double, y double")
    sc = fit_scalers(c, ["x"], "y")
    assert {r["y"] for r in transform(c, sc).collect()} == {0.0}


def test_absent_feature_is_raw_zero(spark):
    from hourcast.operators.scaling import Scalers, transform

    s = Scalers(["x", "gone"], "y", {"x": 1.0, "gone": 14.0}, {"x": 0.0, "gone": 12.0}, {"x": 2.0, "gone": 16.0})
    row = transform(spark.createDataFrame([(3.0, 9.0)], "x double, extra double"), s).first()
    assert row.asDict() == {"x": 1.0, "gone": -3.5}
