import __spark_entry__ as entry


def test_registry():
    names = entry.queries()
    assert len(names) > 90 and set(entry.oracle_sql()) <= set(names)


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["date", "ticker", "value"] and out.where("value is not null").count() > 0
