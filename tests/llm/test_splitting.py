"""Pieces: within the limit, nothing lost, shared as asked, forced only by a long run."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import splitting as X

TEXT = st.lists(st.sampled_from(["word ", "a", "\n\n", "。", "！", ". ", "long" * 3, "  ", "b" * 17, "x" * 16, "é"]), max_size=80).map("".join)


@settings(max_examples=1500, deadline=None)
@given(TEXT, st.integers(1, 12), st.none() | st.integers(0, 14))
def test_pieces(text, budget, overlap):
    out = list(X.pieces(text, budget, overlap))
    assert out[0][0] == 0 and out[-1][1] == len(text)
    assert all(-(-(e - s) // 4) <= budget for s, e, _ in out)
    assert all(b[0] <= a[1] < b[1] and a[0] < b[0] for a, b in zip(out, out[1:]))  # no gap, and progress
    back = min(overlap or 0, budget - 1) * 4
    assert all(a[1] - b[0] <= back for a, b in zip(out, out[1:]))
    run = max((len(r) for r in re.split(r"[\s。！？]", text)), default=0)
    if len(text) > 4 * budget:
        assert all(n for *_, n in out) == (run <= 4 * budget)


def test_overlap_is_exact_where_it_can_be():
    text = "some words here. " * 400
    out = list(X.pieces(text, 100, 10))
    assert all(a[1] - b[0] == 40 for a, b in zip(out, out[1:])) and all(n for *_, n in out)


def test_defined_results():
    assert list(X.pieces(None, 5)) == [(0, 0, True)] and list(X.pieces("", 5)) == [(0, 0, True)] and list(X.pieces("abc", None)) == [(0, 3, True)]
    assert list(X.pieces("x" * 10**6, 4, 1))[-1][1] == 10**6
    with pytest.raises(ValueError):
        list(X.pieces("abcdef", 0))


def test_found_on_dirty_rows(spark):
    messages = spark.createDataFrame(
        [(1, 1, "w " * 50, "c"), (1, 1, "w " * 50, "c"), (2, 1, "x" * 100, "c"), (3, 1, "short", "c"), (4, 2, "w " * 5000, "c"), (5, 3, "w " * 9000, "c"), (6, None, "w " * 99, "c"), (7, 1, None, "c")], "msg_id long, conv_id long, text string, budget string"
    )
    schema = "report_id long, conv_id long, created_at timestamp_ntz, budget_tokens int, overlap_tokens int, profile string"
    from datetime import datetime as D

    reports = spark.createDataFrame([(1, 1, D(2025, 1, 1), 1, 0, None), (2, 1, D(2025, 1, 2), 10, None, "full"), (3, 3, D(2025, 1, 1), None, 8, "lite"), (4, 2, D(2025, 1, 1), None, None, None), (5, 2, None, 5, None, None)], schema)
    assert {tuple(r) for r in X.found(messages, reports).collect()} == {(1, "natural"), (2, "forced"), (5, "natural")}
    assert X.found(messages, spark.createDataFrame([], schema)).count() == 0


def test_many_pieces_are_handed_on_a_few_at_a_time(spark, monkeypatch):
    """100,000 characters in pieces of 16,000 that step forward by 4: half a billion characters in all, never more than a batch at once."""
    rows = spark.createDataFrame([(1, "some words, " * 2500, 4000, 3999), (2, None, 5, 0), (3, "ab", None, None)], "msg_id long, text string, budget int, overlap int")
    got = X.split(rows).groupBy("msg_id").agg({"piece": "count", "end": "max"}).collect()
    assert {r.msg_id for r in got} == {1, 2, 3} and max(r["count(piece)"] for r in got) > 1000
    assert all(r["max(end)"] == {1: 30000, 2: 0, 3: 2}[r.msg_id] for r in got)
