"""Operators that SQL expresses, against DuckDB on the smallest tables."""

import pytest

from graphloom.llm import queries
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = queries.queries()[name](spark, sf).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert len(want) and sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_operator_is_registered(spark, sf):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 14))
