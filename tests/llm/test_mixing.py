"""Mixing: the schedule's deviation, the shares, the caps."""

from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import mixing as X


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=8))
def test_schedule_stays_within_a_block(weights):
    total, got = sum(weights), dict.fromkeys(range(len(weights)), 0)
    share = {str(i): Fraction(w) for i, w in enumerate(weights)}
    out = X.schedule(share, 400)
    assert len(out) == 400
    for t, (s, j) in enumerate(out, 1):
        assert j == got[int(s)]
        got[int(s)] += 1
        assert all(abs(got[i] - Fraction(w, total) * t) < 1 for i, w in enumerate(weights))


def test_plan_skips_what_cannot_be_used():
    rows = [{"source": s, "weight": w, "cap": c, "tokens": t, "documents": 1} for s, w, c, t in (("a", 3.0, 1, 300), ("b", 1.0, 2, 100), ("c", 0.0, 1, 5), ("d", 9.0, 1, None), ("e", None, 1, 5), ("f", 5.0, 0, 5))]
    assert {r["source"]: r["target"] for r in X.plan(rows)} == {"a": 300, "b": 100, "c": 0, "d": 0, "e": 0, "f": 0}
    assert X.plan([]) == []


def test_mix_and_shares(spark):
    docs = [(i, f"word number {i} and a few more", "big") for i in range(300)] + [(1000 + i, f"word number {i} and a few more", "small") for i in range(20)] + [(2000, None, "small"), (2001, "x", None), (2002, "x", "unlisted"), (2003, "", "big")]
    documents = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("big", 1.0, 1), ("small", 1.0, 3), ("none", 5.0, 1), ("zero", 0.0, 1), (None, 1.0, 1), ("small", 0.5, 2)], "source string, target_weight double, max_repeats int")
    uses = X.mix(documents, targets).collect()
    assert all(1 <= u.copy <= (3 if u.source == "small" else 1) for u in uses) and len({(u.doc_id, u.copy) for u in uses}) == len(uses)
    assert {u.source for u in uses} == {"big", "small"}
    got = {r.source: r for r in X.shares(documents, targets).collect()}
    assert abs(got["big"].actual_share - 0.5) < 0.05 and got["small"].most_uses == 3 and got["none"].tokens == 0 and got["zero"].actual_share == 0
    order = sorted(uses, key=lambda u: (u.slot, u.source, u.at))
    total, run = sum(u.tokens for u in uses), 0
    for u in order:
        run += u.tokens * (u.source == "big")
    assert run / total == pytest.approx(got["big"].actual_share)


def test_a_source_without_slot_is_in_the_mix(spark):
    documents = spark.createDataFrame([(i, f"word number {i} and a few more", "big") for i in range(300)] + [(1000 + i, "word", "tiny") for i in range(3)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 400.0, 1), ("tiny", 1.0, 1)], "source string, target_weight double, max_repeats int")
    rows, planned = X.mixed(documents, targets, blocks=10)
    assert {s["source"] for s in planned if s["target"] > 0} == {"big", "tiny"} and "tiny" not in {s for s, _ in X.schedule({s["source"]: s["share"] for s in planned}, 10)}
    uses = rows.collect()
    assert {u.slot for u in uses if u.source == "tiny"} == {9} and {u.doc_id for u in uses if u.source == "tiny"} == {1000, 1001, 1002}


def test_the_smallest_share_gets_a_slot():
    rows = lambda *w: X.plan([{"source": str(i), "weight": x, "cap": 1, "tokens": 10**9, "documents": 1} for i, x in enumerate(w)], wanted=10**8)
    for planned, slots in ((rows(1.0, 1.0), X.BLOCKS), (rows(1e5, 1.0), 100_001), (rows(1e9, 1.0), X.MOST_BLOCKS)):
        assert X.slots_for(planned) == slots
    planned = rows(70_000.0, 29_998.0, 1.0, 1.0)
    got = {s for s, _ in X.schedule({s["source"]: s["target"] for s in planned}, X.slots_for(planned))}
    assert got == {"0", "1", "2", "3"}


def test_a_tiny_share_keeps_its_documents(spark):
    documents = spark.createDataFrame([(i, f"word number {i} and a few more", "big") for i in range(300)] + [(1000 + i, "word", "tiny") for i in range(3)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 1e6, 1), ("tiny", 1.0, 1)], "source string, target_weight double, max_repeats int")
    uses = X.mix(documents, targets, wanted=3_000_000).collect()
    assert {u.doc_id for u in uses if u.source == "tiny"} == {1000, 1001, 1002} and len(uses) == 303
    short = {r.source: r.shortfall_tokens for r in X.shares(documents, targets, wanted=3_000_000).collect()}
    assert short["big"] > 2_990_000 and short["tiny"] == 0


def test_empty(spark):
    documents = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    assert X.mix(documents, targets).count() == 0 and X.shares(documents, targets).collect()[0].tokens == 0
