"""Queries with SQL, against DuckDB on the same tables."""

import pytest

from quillmere.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    same_rows(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)
