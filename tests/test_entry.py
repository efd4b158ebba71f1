import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 4 and df.columns[0] == "column_name"


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 50
