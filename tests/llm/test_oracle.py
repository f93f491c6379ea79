"""The registered queries that have SQL, against DuckDB."""

import pytest

from centrum.llm import queries
from tests.oracle_check import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_its_sql(spark, name, sf):
    data = f"/root/testdata/sf{sf}"
    assert compare(spark, connect(data), name, queries.QUERIES[name], queries.ORACLES[name], data) is None
