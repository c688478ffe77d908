"""Every query of the engine against its SQL."""

import pytest

from arborweft.operators import bindings

ORACLE = bindings.oracle_sql()


@pytest.mark.parametrize("name", sorted(bindings.queries()))
def test_query_equals_sql(name, same_rows):
    same_rows(bindings.queries()[name], ORACLE[name])


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(bindings.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
