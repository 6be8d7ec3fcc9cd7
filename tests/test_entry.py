"""Driver contract: entry runs, every oracle key is a query key."""


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"Branch", "action_type", "n_bookings", "mean_probability", "revenue_at_risk"}
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 150
