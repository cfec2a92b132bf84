"""Queries with an SQL form against DuckDB on the smallest tables."""

import pytest
from conftest import same

from dossier.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, sf, name):
    assert same(QUERIES[name](spark, sf), duck.sql(ORACLE_SQL[name]))
