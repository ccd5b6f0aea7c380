"""Flattening against a plain recursive walk, on made-up records of every shape."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.operators import nested as N

RECORD = {
    "uuid": "u1",
    "chat_messages": [
        None, 7, "stray",
        {"text": "own", "content": [{"type": "text", "text": "a"}, None, "bare", 5, {"type": "tool_result", "content": [{"text": "deep"}, {"type": "tool_use", "input": {"token": 12, "other": {"token": "no"}}}]}]},
        {"content": {"type": "tool_use", "input": '{"token": "t", "limit": 3}'}, "attachments": {"private_runtime_url": "u", "size": 1.50}},
        {"content": "just text", "attachments": [{"private_runtime_url": None}, {"private_runtime_url": "v"}]},
        {"content": [{"type": "tool_use", "input": "not json"}], "attachments": None},
    ],
}
WANT = {
    (3, "content", "0", "type", "text"), (3, "content", "0", "text", "a"), (3, "content", "2", "text", "bare"), (3, "content", "4", "type", "tool_result"), (3, "content", "4.0", "text", "deep"),
    (3, "content", "4.1", "type", "tool_use"), (3, "content", "4.1", "token", "12"), (4, "content", "0", "type", "tool_use"), (4, "content", "0", "token", "t"),
    (4, "attachments", "0", "private_runtime_url", "u"), (5, "content", "0", "text", "just text"), (5, "attachments", "1", "private_runtime_url", "v"), (6, "content", "0", "type", "tool_use"),
}


def frame(spark, contents):
    return spark.createDataFrame([(str(i), c) for i, c in enumerate(contents)], "path string, content string")


def test_fields_of_every_shape_once(spark):
    one, listed, wrapped = json.dumps(RECORD), json.dumps([RECORD, 1, {"kind": "x"}]), json.dumps({"conversations": [RECORD]})
    rows = N.content_fields(frame(spark, [one, listed, wrapped, None, "", "  ", "{", "[1, 2]", '{"chat_messages": "none"}', '{"uuid": "e", "chat_messages": null}'])).collect()
    assert sorted((r.msg_pos, r.branch, r.node_path, r.field, r.val) for r in rows) == sorted(WANT)
    assert {r.conv_uuid for r in rows} == {"u1"}


def test_tables_keep_parents(spark):
    rows = N.pivot_table(frame(spark, [json.dumps(RECORD)]), "chat_messages[].attachments[]", ["private_runtime_url", "size"]).collect()
    assert {(tuple(r.ordinals), tuple(r.parent), r.private_runtime_url, r.size) for r in rows} == {((4, 0), (4,), "u", "1.5"), ((5, 1), (5,), "v", None), ((5, 0), (5,), None, None)}
    assert N.content_fields(frame(spark, [])).count() == 0


def test_records_without_uuid_stay_apart(spark):
    two = [{"chat_messages": [{"sender": "human", "attachments": {"size": n}}]} for n in (1, 2)]
    rows = frame(spark, [json.dumps(two), json.dumps(two[0])])
    assert {(r.path, r.record, r.size) for r in N.pivot_table(rows, "chat_messages[].attachments[]", ["size"]).collect()} == {("0", 0, "1"), ("0", 1, "2"), ("1", 0, "1")}
    assert {(r.path, r.record, tuple(r.ordinals)) for r in N.pivot_table(rows, "chat_messages[]", ["sender"]).collect()} == {("0", 0, (0,)), ("0", 1, (0,)), ("1", 0, (0,))}


def test_objects_without_leaves_have_rows(spark):
    rows = frame(spark, [json.dumps({"chat_messages": [{"content": [{}]}, 5, "stray", None, {"sender": "human"}]})])
    assert {(tuple(r.ordinals), r.sender) for r in N.pivot_table(rows, "chat_messages[]", ["sender"]).collect()} == {((0,), None), ((4,), "human")}
    assert {(tuple(r.ordinals), tuple(r.parent), r.text) for r in N.pivot_table(rows, "chat_messages[].content[]", ["text"]).collect()} == {((0, 0), (0,), None)}
    assert [(r.ordinals, r.parent, r.uuid) for r in N.pivot_table(rows, "", ["uuid"]).collect()] == [([], None, None)]


values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["content", "type", "text", "input", "a"]), x, max_size=3), max_leaves=12)


def brute(value, path="", at=(), key=""):
    """A plain recursive walk over the parsed tree."""
    if value is None:
        return
    if key == "input" and isinstance(value, str):
        try:
            value = json.loads(value, parse_constant=lambda c: None)
        except ValueError:
            return
        if value is None:
            return
    if key in N.CHAT.lists and not isinstance(value, list):
        value = [value]
    if isinstance(value, dict):
        for k, v in value.items():
            yield from brute(v, f"{path}.{k}" if path else k, at, k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from brute({"text": v} if key == "content" and isinstance(v, str) else v, path + "[]", (*at, i), "")
    elif isinstance(value, bool):
        yield path, at, str(value).lower()
    else:
        yield path, at, str(value)


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.sampled_from(["content", "b", "uuid"]), values, max_size=3), values, st.sampled_from(["plain", "listed", "wrapped"]))
def test_triples_equal_a_recursive_walk(record, messages, form):
    record = {**record, "chat_messages": messages}
    root = {"plain": record, "listed": [7, record, {"b": 1}], "wrapped": {"x": [record], "conversations": [None, record]}}[form]
    got = list(N.triples(json.dumps(root)))
    assert [(place, own) for place, _, own in got] == [(int(form != "plain"), list(brute(record)))]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='{}[],:"ab\\u0.eE+-19 \nntrulfas', max_size=14) | values.map(json.dumps))
def test_the_same_texts_are_readable(text):
    try:
        json.loads(text)
        readable = True
    except ValueError:
        readable = False
    try:
        for _ in N.events(text):
            pass
        assert readable
    except ValueError:
        assert not readable


def test_repeated_keys_halves_of_pairs_and_dots_in_keys():
    text = '{"uuid": "a", "chat_messages": [{"content": "x"}], "uuid": "b", "chat_messages": [{"content": [{"text": "y\\ud800", "input.token": "no", "input": {"token": 1.50, "token": NaN}}]}]}'
    (place, key, own), = N.triples(text)
    assert (place, key) == (0, "b") and own == [("uuid", (), "b"), ("chat_messages[].content[].text", (0, 0), "y?"), ("chat_messages[].content[].input\\.token", (0, 0), "no")]


def test_depth_is_no_bound():
    depth = 100_000
    deep = '{"uuid": "d", "chat_messages": [{"content": ' + '[{"content": ' * depth + '"end"' + "}]" * depth + "}]}"
    (_, key, own), = N.triples(deep)
    assert key == "d" and len(own) == 2 and len(own[1][1]) == depth + 2 and own[1][2] == "end"
    assert list(N.triples('{"chat_messages": ' + "[" * depth)) == []
