"""Every query of the package against its SQL, or run to its end."""

import pytest

from colloquy.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(name, spark, sf):
    assert queries.QUERIES[name](spark, sf).count() > 0
