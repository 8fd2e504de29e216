import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "trip_count_lag_24" in df.columns


def test_every_sql_query_has_an_oracle():
    from hourcast.plans.model_queries import MODEL_REGISTRY
    from hourcast.plans.queries import REGISTRY

    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and set(REGISTRY) | set(MODEL_REGISTRY) <= set(qs)
    # trained trees and penalised fits are the only queries of the library without one
    needed = set(REGISTRY) | {k for k in MODEL_REGISTRY if k.startswith("model_ols_")}
    assert needed <= set(sql)
