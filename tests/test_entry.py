"""The driver's contract."""

import __spark_entry__


def test_names_and_flagship(spark):
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    df = __spark_entry__.entry(spark)
    assert df.columns[:2] == ["type_qualified", "interface_qualified"] and df.count() > 0
