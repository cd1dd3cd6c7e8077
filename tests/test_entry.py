import __spark_entry__ as E


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"token_id", "token", "occurrences", "frequency"}
    assert df.count() > 0
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 45
