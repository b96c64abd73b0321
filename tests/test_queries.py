"""Every registered query over source code against its SQL."""

import pytest

from tessera import registry


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(name, spark, sf_dir, same_rows):
    same_rows(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_entry_points(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.entry(spark).limit(1).columns) > 3
