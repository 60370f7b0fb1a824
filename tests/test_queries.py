"""Every registered query against its SQL, on the smallest tables."""

import pytest
from conftest import rows_of, rows_of_sql

from loomlake.jobs import registry


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    assert rows_of(registry.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, registry.ORACLE_SQL[name])


def test_entry_point_lists_the_queries():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
