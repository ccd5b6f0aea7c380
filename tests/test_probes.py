"""Looking into JSON of any schema, against plain recursion over parsed trees."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.operators import probes as X

words = st.sampled_from(["UU", "AA", "x", "UU AA", "text", "token", ""])
values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | words, lambda x: st.lists(x, max_size=3) | st.dictionaries(words, x, max_size=3), max_leaves=14)


def strings(value):
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield k
            yield from strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from strings(v)


def holds(value, *needles):
    return all(any(n in s for s in strings(value)) for n in needles)


def innermost(value):
    children = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
    inner = [c for v in children for c in innermost(v)]
    return inner or ([value] if isinstance(value, dict) and holds(value, "UU", "AA") else [])


def outermost(value, keys):
    if isinstance(value, dict) and any(k in value for k in keys) and holds(value, "UU"):
        return [value]
    children = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
    return [c for v in children for c in outermost(v, keys)]


def hidden(value):
    """A tree without content, but for keys that need no hiding."""
    if isinstance(value, dict):
        return {k: hidden(v) for k, v in value.items()}
    if isinstance(value, list):
        return [hidden(v) for v in value]
    if isinstance(value, str):
        return " ".join(n for n in ("UU", "AA") if n in value) or (value if value in X.STRUCTURAL else "<redacted:string>")
    return value if value is None or isinstance(value, bool) else "<redacted:number>"


@settings(max_examples=400, deadline=None)
@given(values)
def test_contexts_and_records_equal_recursion(value):
    text = json.dumps(value)
    assert X.contains(text, ["UU"]) == holds(value, "UU") and not X.contains(text, [""])
    safe = lambda tree: json.loads(X.sanitised(json.dumps(tree), None, ["UU", "AA"]))
    got = [json.loads(X.sanitised(text, span, ["UU", "AA"])) for span in X.contexts(text, "UU", "AA")]
    assert sorted(map(json.dumps, got)) == sorted(json.dumps(safe(v)) for v in innermost(value))
    monkey = dict(X.PROVIDERS)
    X.PROVIDERS["any"] = (("x", "text"), False)
    try:
        spans = X.records(text, "any", "UU")
    finally:
        X.PROVIDERS.clear()
        X.PROVIDERS.update(monkey)
    assert len(spans) == len(outermost(value, ("x", "text")))


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | words, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "role"]), x, max_size=3), max_leaves=14))
def test_sanitised_structure(value):
    assert json.loads(X.sanitised(json.dumps(value), None, ["UU", "AA"])) == hidden(value)


def test_suspicious_keys_are_numbered():
    text = json.dumps({"a@b.test": 1, "sessionToken": "s", "UU": {"ok": "private"}, "x" * 121: None, "fine": 2.5})
    assert json.loads(X.sanitised(text, None, ["UU"])) == {"<redacted-key-1>": "<redacted:number>", "<redacted-key-2>": "<redacted:string>", "<redacted-key-3>": {"ok": "<redacted:string>"}, "<redacted-key-4>": None, "fine": "<redacted:number>"}


def test_depth_is_no_bound():
    deep = "[" * 50_000 + '{"k": ["UU", "AA"]}' + "]" * 50_000
    assert len(X.contexts(deep, "UU", "AA")) == 1 and X.contains(deep, ["AA"])


def test_files(spark):
    both = json.dumps({"chat_messages": [{"t": "UU"}, {"t": "AA"}], "account": "private"})
    rows = [("a.json", both), ("b.jsonl", f"{both}\n\n{{\n\"UU\"\n"), ("c.html", "<p>UU</p>"), ("d.json", None), ("e.json", "\ufeff" + both), ("f.json", '"' + "x" * 400 + '"')]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "path string, content string, status string")
    got = {(r.path, r.document): r for r in X.scan(files, "UU", "AA", most_chars=300).collect()}
    assert {k: r.status for k, r in got.items()} == {("a.json", 0): "ok", ("b.jsonl", 0): "ok", ("b.jsonl", 1): "unreadable", ("b.jsonl", 2): "ok", ("c.html", 0): "other", ("d.json", 0): "unreadable", ("e.json", 0): "ok", ("f.json", 0): "too_large"}
    assert (got["a.json", 0].first_count, got["a.json", 0].contexts) == (1, 1) and "private" not in got["a.json", 0].sanitised
    found = X.provider_records(files, "claude", "AA").collect()
    assert {r.path for r in found} == {"a.json", "b.jsonl", "e.json"} and all("private" not in r.sanitised for r in found)
    assert {(r.path, r.found) for r in X.deep_contains(files, "path", "content", ["AA"]).collect()} == {("a.json", True), ("b.jsonl", True), ("c.html", False), ("d.json", False), ("e.json", True), ("f.json", False)}
    assert X.scan(files.where("path = ''"), "UU", "AA").count() == 0


@pytest.mark.parametrize("provider", sorted(X.PROVIDERS))
def test_known_providers(provider):
    record = {"claude": {"chat_messages": ["UU"]}, "gemini": {"safeHtmlItem": [{"html": "UU"}]}}[provider]
    assert len(X.records(json.dumps({"more": [record, {"chat_messages": "UU"}]}), provider, "UU")) == 1
