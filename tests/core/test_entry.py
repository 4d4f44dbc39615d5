"""The driver's contract."""

import __spark_entry__ as entry


def test_contract(spark):
    found, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(found) and all(callable(q) for q in found.values())
    assert all(isinstance(s, str) and s.strip() for s in oracles.values())
    df = entry.entry(spark)
    assert df.columns == ["id", "n"] and df.count() == 10
