"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

from facetflow import queries as mesh_queries

from .conftest import same_result

#: Checked at the next scale by the driver; their SQL counts a strip of one row of cells.
LARGER_ONLY = {"extrude_strip"}


@pytest.mark.parametrize("name", sorted(set(mesh_queries.oracle_sql()) - LARGER_ONLY))
def test_query_matches_sql(spark, duck, sf, name):
    same_result(spark, duck, mesh_queries.queries()[name], mesh_queries.oracle_sql()[name], sf)


def test_sql_has_queries():
    assert set(mesh_queries.oracle_sql()) <= set(mesh_queries.queries())


def test_entry_point_lists_queries(spark):
    import __spark_entry__

    assert set(mesh_queries.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 1
