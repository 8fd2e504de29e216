import numpy as np

from hourcast.operators.metrics import pooled_metrics, regression_metrics


def test_metrics_match_numpy(spark):
    t = np.array([10.0, 20.0, 30.0, 40.0])
    p = np.array([12.0, 18.0, 33.0, 38.0])
    df = spark.createDataFrame([(float(a), float(b), "weekday" if i < 2 else "weekend")
                                for i, (a, b) in enumerate(zip(t, p))], "actual double, predicted double, member string")
    r = regression_metrics(df).first()
    e = p - t
    assert abs(r["mae"] - np.abs(e).mean()) < 1e-12
    assert abs(r["rmse"] - np.sqrt((e ** 2).mean())) < 1e-12
    assert abs(r["r2"] - (1 - (e ** 2).sum() / ((t - t.mean()) ** 2).sum())) < 1e-12
    smape = np.mean(2 * np.abs(p - t) / (np.abs(t) + np.abs(p) + 1e-10))
    assert abs(r["smape"] - smape) < 1e-12 and 0 <= r["smape"] <= 2
    hub = np.mean(np.where(np.abs(e) <= 1, 0.5 * e ** 2, np.abs(e) - 0.5))
    assert abs(r["huber"] - hub) < 1e-12
    pooled = {x["member"]: x for x in pooled_metrics(df).collect()}
    assert set(pooled) == {"weekday", "weekend", "all"} and pooled["all"]["n"] == 4


def test_r2_constant_target(spark):
    df = spark.createDataFrame([(5.0, 5.0), (5.0, 5.0)], "actual double, predicted double")
    assert regression_metrics(df).first()["r2"] == 1.0
    df = spark.createDataFrame([(5.0, 4.0), (5.0, 5.0)], "actual double, predicted double")
    assert regression_metrics(df).first()["r2"] == 0.0
