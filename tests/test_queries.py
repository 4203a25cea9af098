"""Every registered query of the core runs, and equals its SQL counterpart where it has one."""

from __future__ import annotations

import pytest
from compare import assert_same

from stratiset.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, name):
    df = registry.queries()[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        assert_same(df, SQL[name], data)
    else:
        assert df.count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
