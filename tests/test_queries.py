"""Every query of the core against its SQL, or at least run to its end."""

import pytest

from colloquy.plans import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(name, spark, sf):
    frame = queries.QUERIES[name](spark, sf)
    rows = frame.collect()  # the smallest tables have no account whose zone shows
    assert (rows or name == "p4_estimated") and len({tuple(map(str, r)) for r in rows}) == len(rows)


def test_entry_has_rows(spark, sf):
    import __spark_entry__ as entry

    assert entry.queries()["conversation_integrity"](spark, sf).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_conversation_integrity_pushes_its_filter_and_columns(spark, sf):
    plan = queries.QUERIES["conversation_integrity"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(role, [assistant,user])" in plan or "In(role" in plan
    assert "account_id" not in plan.split("ReadSchema")[1].split("\n")[0]
