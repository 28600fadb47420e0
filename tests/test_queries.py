"""Every query against its SQL, on the smallest tables."""

import pytest

from quillspark import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(name, spark):
    from conftest import DATA

    catalogue.QUERIES[name](spark, DATA).collect()


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
