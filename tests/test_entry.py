import __spark_entry__ as entry


def test_names_agree_and_the_flagship_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["p_brand", "rmse", "pearson", "composite"] and df.count() == 25
