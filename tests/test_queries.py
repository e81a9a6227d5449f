"""Every registered query of the core against its SQL, on the smallest tables."""

import pytest

from copse import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, same, name):
    same(queries.QUERIES[name](spark, SF), duck.sql(queries.SQL[name]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc", "kind", "name"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
