"""Every registered query against its SQL in DuckDB; queries without SQL must return rows."""

import pytest

from centrum.queries import registry
from tests.oracle_check import compare, connect

registry.load_all()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, folder, name):
    problem = compare(spark, con, name, registry.QUERIES[name], registry.ORACLES.get(name), folder)
    assert problem is None, problem
    spark.catalog.clearCache()


def test_every_sql_belongs_to_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
