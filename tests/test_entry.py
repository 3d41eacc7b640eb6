import __spark_entry__


def test_contract(spark):
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 40
    assert __spark_entry__.entry(spark).limit(1).count() == 1
