"""Flattening of nested JSON records into related flat tables.

A file is read as a stream of tokens, without a tree and without recursion, so its depth is bounded by nothing but its
length. The stream gives triples ``(path, ordinals, literal)``: the path names the object keys, each ``[]`` in it is a
list, and ``ordinals`` holds the place in each of these lists. Triples whose paths share the last ``[]`` (``table_path``)
and whose ordinals are equal are the leaves of one object; :func:`objects` gathers them into one row. A file holds whole
objects, so nothing is exchanged for that. :func:`pivot_table` turns the leaves of a table into columns. A row is keyed by its file, the place of
its record in the file and its ordinals, so a child row names its parent by a prefix of its own key, also where a record has no uuid.

Defined results: unreadable or empty content yields nothing; null leaves, NaN and infinities yield nothing; a single
value where ``Shape.lists`` declares a list is a list of one; a string in such a list that has an
entry in ``Shape.bare`` becomes that field; nulls and strays keep their places but yield nothing;
numbers keep the digits they were written with; of repeated keys in one object the last holds; halves of surrogate pairs
become question marks; dots and brackets in a key are escaped by a backslash in the path.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.common import python_partitions


@dataclass(frozen=True)
class Shape:
    """What is known of the records: their mark and wrapper, repeated keys, bare strings in them, and embedded JSON."""

    mark: str
    wrapper: str
    lists: frozenset[str] = frozenset()
    bare: dict[str, str] = field(default_factory=dict)
    embedded: frozenset[str] = frozenset()


CHAT = Shape("chat_messages", "conversations", frozenset({"chat_messages", "content", "attachments"}), {"content": "text"}, frozenset({"input"}))

TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|(")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false)|(null|NaN|-?Infinity))')
TRAIL = re.compile(r"[ \t\n\r]*\Z")
Event = tuple[str, str | None]


def events(text: str) -> Iterator[Event]:
    """The JSON text as ``{ } [ ]``, ``k`` (a key), ``s`` (a string), ``n`` (a number's digits), ``b`` (true, false) and ``-`` (nothing).

    ValueError where the text is no JSON value; events before that place have been given already.
    """
    open_: list[str] = []
    match, at, want = TOKEN.match, 0, "value"
    while True:
        if want == "end":
            if not TRAIL.match(text, at):
                raise ValueError("more than one value")
            return
        m = match(text, at)
        if m is None:
            raise ValueError("no token")
        at, mark = m.end(), m[1]
        if mark in ("}", "]"):
            if not open_ or open_[-1] != ("{" if mark == "}" else "[") or want not in ("next", "first"):
                raise ValueError("closed too early")
            open_.pop()
            yield mark, None
        elif mark == ",":
            if want != "next":
                raise ValueError("no value before a comma")
            want = "key" if open_[-1] == "{" else "value"
            continue
        elif mark == ":":
            if want != "colon":
                raise ValueError("no key before a colon")
            want = "value"
            continue
        elif want == "key" or want == "first" and open_[-1] == "{":
            if not m[2]:
                raise ValueError("no key")
            key, at = scanstring(text, at)
            yield "k", key
            want = "colon"
            continue
        elif want not in ("value", "first"):
            raise ValueError("no value is due")
        elif mark:
            open_.append(mark)
            yield mark, None
            want = "first"
            continue
        elif m[2]:
            value, at = scanstring(text, at)
            yield "s", value
        elif m[3] is not None:
            yield "n", m[3]
        else:
            yield ("b", m[4]) if m[4] else ("-", None)
        want = "next" if open_ else "end"


class Frame:
    """An open object or list; its path is made only when a leaf below needs it."""

    __slots__ = ("above", "step", "ordinals", "depth", "index", "key", "spans", "made")

    def __init__(self, above: Frame | None, step: str, ordinals: tuple[int, ...], is_list: bool):
        self.above, self.step, self.ordinals = above, step, ordinals
        self.depth = (above.depth if above else 0) + len(ordinals)
        self.index, self.key, self.made = -1, "", None
        self.spans: dict[str, int] | None = None if is_list else {}

    def place(self) -> tuple[str, tuple[int, ...]]:
        if self.made is None:
            chain, f = [], self
            while f is not None and f.made is None:
                chain.append(f)
                f = f.above
            chain.reverse()
            path, at = f.made if f else ("", ())
            self.made = path + "".join(x.step for x in chain), at + tuple(i for x in chain for i in x.ordinals)
        return self.made


def escaped(key: str) -> str:
    return re.sub(r"([\\.\[\]])", r"\\\1", key)


def clean(text: str) -> str:
    """Without halves of surrogate pairs, which no column can hold."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


Triple = tuple[str, tuple[int, ...], str]


class Reader:
    """Reads one text; ``found`` are its triples, and a triple without path for an object that is a record or is to have a row in any case."""

    def __init__(self, shape: Shape, wanted: re.Pattern | None = None, depth: int = -1):
        self.shape, self.wanted, self.depth = shape, wanted, depth
        self.found: list[Triple | None] = []
        self.root: Frame | None = None
        self.wrapped = False

    def read(self, text: str, above: Frame | None = None) -> None:
        """ValueError if the text is no JSON; what has been found till then stays in ``found``."""
        shape, found, stack = self.shape, self.found, []
        for kind, value in events(text):
            if kind == "k":
                frame = stack[-1]
                frame.key = value
                if value in frame.spans:  # the earlier value of a repeated key doesn't hold
                    first, last = frame.spans[value]
                    found[first:last] = [None] * (last - first)
                frame.spans[value] = (len(found), len(found))
                continue
            if kind in "}]":
                frame = stack.pop()
                if kind == "}" and (shape.mark in frame.spans or frame.depth <= self.depth + 1 and (frame.ordinals or frame.above is None)):
                    found.append((None, frame.place(), shape.mark in frame.spans))
                if stack and stack[-1].spans is not None:
                    stack[-1].spans[stack[-1].key] = (stack[-1].spans[stack[-1].key][0], len(found))
                continue
            parent = stack[-1] if stack else above
            key, step, ordinals, bare = "", "", (), None
            if stack:
                if parent.spans is None:
                    parent.index += 1
                    step, ordinals, bare = "[]", (parent.index,), shape.bare.get(parent.key)
                else:
                    key = parent.key
                    step = ("." if parent.above is not None or parent.step else "") + escaped(key)
            if parent is self.root and key == shape.wrapper and above is None:
                self.wrapped = kind == "["
            if key in shape.lists and kind != "[":
                if kind == "-":
                    continue
                step, ordinals, bare = f"{step}[]", (0,), shape.bare.get(key)
            if kind in "{[":
                frame = Frame(parent, step, ordinals, kind == "[")
                frame.key = key
                if parent is None:
                    self.root = frame
                stack.append(frame)
                continue
            if kind == "-":
                continue
            start = len(found)
            if kind == "s" and key in shape.embedded:
                try:
                    self.read(value, Frame(parent, step, ordinals, True))
                except ValueError:
                    del found[start:]
            else:
                if bare and kind == "s":
                    step = f"{step}.{bare}"
                path, at = parent.place() if parent else ("", ())
                path += step
                if self.wanted is None or self.wanted.search(path):
                    found.append((path, at + ordinals, clean(value) if kind == "s" else value))
            if stack and parent.spans is not None:
                parent.spans[key] = (parent.spans[key][0], len(found))

    def records(self, text: str | None) -> Iterator[tuple[int, str | None, list[Triple]]]:
        """Place in the file, uuid and triples of each record: the file itself, the items of an array, or those below the wrapper."""
        try:
            self.read(text or "")
        except ValueError:
            return
        if self.root is None:
            return
        if self.root.spans is None:
            prefix = "[]"
        elif self.shape.mark in self.root.spans:
            prefix = ""
        elif self.wrapped:
            prefix = f"{self.shape.wrapper}[]"
        else:
            return
        depth = int(prefix != "")
        have = {place[1] for path, place, marked in (x for x in self.found if x and x[0] is None) if marked and place[0] == prefix}
        dot = f"{prefix}." if prefix else ""
        by: dict[tuple[int, ...], list[Triple]] = {at: [] for at in sorted(have)}
        for t in self.found:
            if t and t[0] is None and self.depth >= 0:  # an object's row, leaves or not
                path, at = t[1]
                if at[:depth] in have and (path == prefix or path.startswith(dot)) and len(at) - depth <= self.depth:
                    by[at[:depth]].append((path.removeprefix(prefix).removeprefix("."), at[depth:], None))
            elif t and t[0] is not None and t[0].startswith(dot) and t[1][:depth] in have:
                by[t[1][:depth]].append((t[0][len(dot) :], t[1][depth:], t[2]))
        for at, own in by.items():
            yield at[0] if at else 0, next((v for path, _, v in own if path == "uuid"), None), own


def triples(text: str | None, shape: Shape = CHAT, wanted: re.Pattern | None = None, depth: int = -1) -> Iterator[tuple[int, str | None, list[Triple]]]:
    """Place, uuid and triples of each record of a file; null as literal stands for an object in up to ``depth`` lists."""
    return Reader(shape, wanted, depth).records(text)


OBJECTS = "path string, record int, conv_uuid string, table_path string, ordinals array<int>, leaves map<string,string>"
ARROW_OBJECTS = pa.schema([("path", pa.string()), ("record", pa.int32()), ("conv_uuid", pa.string()), ("table_path", pa.string()), ("ordinals", pa.list_(pa.int32())), ("leaves", pa.map_(pa.string(), pa.string()))])
#: Objects handed on at once.
BATCH = 10_000


def gathered(own: list[Triple]) -> dict[tuple[str, tuple[int, ...]], dict[str, str]]:
    """The leaves of each object by table path and ordinals."""
    out: dict[tuple[str, tuple[int, ...]], dict[str, str]] = {}
    for path, at, value in own:
        if value is None:
            out.setdefault((path, at), {})
            continue
        head, mark, leaf = path.rpartition("[]")
        out.setdefault((head + mark, at), {})[leaf.removeprefix(".")] = value
    return out


def objects(exports: DataFrame, shape: Shape = CHAT, wanted: str | None = None, depth: int = -1) -> DataFrame:
    """One row per object that has a leaf: its record's file, place and uuid, its table, ordinals and leaves.

    Objects in up to ``depth`` lists below their record have a row also without a leaf. ``wanted`` is a pattern of the paths (from the
    file's root) that are of use; others are read but not kept. A scalar in a list is a row with the one leaf ''.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(wanted) if wanted else None
        rows: list[tuple] = []
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                for place, key, own in triples(text, shape, pattern, depth):
                    for (table_path, at), leaves in gathered(own).items():
                        rows.append((path, place, key, table_path, at, list(leaves.items())))
                        if len(rows) >= BATCH:
                            yield arrow(rows)
                            rows = []
        yield arrow(rows)

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(ARROW_OBJECTS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW_OBJECTS.types)], schema=ARROW_OBJECTS)

    return python_partitions(exports.select("path", "content")).mapInArrow(run, OBJECTS)


def pivot_table(exports: DataFrame, path: str, names: list[str]) -> DataFrame:
    """The table at ``path``: one row per object, with leaves or not, a column per leaf in ``names``, and its parent's ordinals.

    The pivot is a projection: the leaves of an object are in one row already.
    """
    leaf = "|".join(re.escape(n) for n in names)
    rows = objects(exports, wanted=rf"(?:^|[.\]])(?:uuid|{leaf})$", depth=path.count("[]"))
    columns = [F.col("leaves")[n].alias(n.replace(".", "_")) for n in names]
    own = rows.where((F.col("table_path") == path) & ~F.map_contains_key("leaves", F.lit("")))
    parent = F.when(F.size("ordinals") > 0, F.slice("ordinals", F.lit(1), F.size("ordinals") - 1))
    return own.select("path", "record", "conv_uuid", "ordinals", parent.alias("parent"), *columns)


#: Tables of content blocks at any depth and of attachments, and the leaves of use in them.
BELOW = r"^chat_messages\[\]\.(content|attachments)\[\](\.content\[\])*$"
FIELDS = {"type": "type", "text": "text", "input.token": "token", "private_runtime_url": "private_runtime_url"}
WANTED = r"(?:^|[.\]])uuid$|chat_messages\[\]\.(?:content|attachments)\[\].*(?:type|text|token|private_runtime_url)$"


def content_fields(exports: DataFrame) -> DataFrame:
    """The fields of content blocks, tool inputs and attachments with the place of each, from the pivoted tables."""
    own = objects(exports, wanted=WANTED).where(F.col("table_path").rlike(BELOW))
    table = own.select(
        "conv_uuid", F.col("ordinals")[0].alias("msg_pos"), F.regexp_extract("table_path", BELOW, 1).alias("branch"),
        F.array_join(F.slice("ordinals", F.lit(2), F.size("ordinals")).cast("array<string>"), ".").alias("node_path"), *[F.col("leaves")[leaf].alias(name) for leaf, name in FIELDS.items()],
    )
    cells = F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("val")) for name in FIELDS.values()])
    rows = table.select("conv_uuid", "msg_pos", "branch", "node_path", F.explode(cells).alias("cell")).select("conv_uuid", "msg_pos", "branch", "node_path", "cell.field", "cell.val")
    return rows.where("val is not null").distinct()


# ---- the same in SQL, for comparison

SCALAR = "('VARCHAR', 'BIGINT', 'UBIGINT', 'HUGEINT', 'UHUGEINT', 'DOUBLE', 'BOOLEAN')"


def leaf_sql(x: str, *keys: str) -> str:
    """A scalar below ``x`` as text, else null."""
    path = "$" + "".join(f'."{k}"' for k in keys)
    return f"CASE WHEN json_type({x}, '{path}') IN {SCALAR} THEN json_extract_string({x}, '{path}') END"


def list_sql(x: str) -> str:
    """``x`` as a list: itself, nothing for null, a list of one for anything else."""
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN '[]'::JSON WHEN json_type({x}) = 'ARRAY' THEN {x} ELSE json_array({x}) END"


def items_sql(columns: str, source: str, x: str, place: str, item: str) -> str:
    return f"SELECT {columns}, CAST(i AS INTEGER) AS {place}, json_extract({x}, '$[' || i || ']') AS {item} FROM (SELECT *, unnest(range(CAST(json_array_length({x}) AS BIGINT))) AS i FROM {source})"


INPUT = "CASE WHEN json_type(x, '$.input') = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(x, '$.input')) THEN json_extract_string(x, '$.input')::JSON END ELSE json_extract(x, '$.input') END"
TABLES_SQL = f"""
WITH RECURSIVE files AS (SELECT DISTINCT path, content::JSON AS j FROM raw_export WHERE content IS NOT NULL AND json_valid(content) AND NOT regexp_matches(content, ',\\s*[}}\\]]\\s*$')),
listed AS (SELECT path, CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_type(j) <> 'OBJECT' THEN '[]'::JSON WHEN json_exists(j, '$.chat_messages') THEN json_array(j) WHEN json_type(j, '$.conversations') = 'ARRAY' THEN json_extract(j, '$.conversations') ELSE '[]'::JSON END AS l FROM files),
records AS (SELECT *, {leaf_sql('r', 'uuid')} AS conv_uuid FROM ({items_sql('path', 'listed', 'l', 'record', 'r')}) WHERE json_type(r) = 'OBJECT' AND json_exists(r, '$.chat_messages')),
messages AS ({items_sql('path, record, conv_uuid', f"(SELECT path, record, conv_uuid, {list_sql('c')} AS l FROM (SELECT *, json_extract(r, '$.chat_messages') AS c FROM records))", 'l', 'msg_pos', 'm')}),
below AS (
  SELECT path, record, conv_uuid, msg_pos, branch, {list_sql('c')} AS l FROM (SELECT *, json_extract(m, '$.content') AS c, 'content' AS branch FROM messages WHERE json_type(m) = 'OBJECT' UNION ALL SELECT *, json_extract(m, '$.attachments') AS c, 'attachments' AS branch FROM messages WHERE json_type(m) = 'OBJECT')
),
nodes AS (
  SELECT path, record, conv_uuid, branch, [msg_pos, place] AS ordinals, CASE WHEN branch = 'content' AND json_type(item) = 'VARCHAR' THEN json_object('text', item) ELSE item END AS x FROM ({items_sql('path, record, conv_uuid, msg_pos, branch', 'below', 'l', 'place', 'item')})
  UNION ALL
  SELECT path, record, conv_uuid, branch, list_append(ordinals, place) AS ordinals, CASE WHEN json_type(item) = 'VARCHAR' THEN json_object('text', item) ELSE item END AS x
  FROM ({items_sql('path, record, conv_uuid, branch, ordinals', f"(SELECT *, {list_sql('c')} AS l FROM (SELECT *, json_extract(x, '$.content') AS c FROM nodes WHERE json_type(x) = 'OBJECT'))", 'l', 'place', 'item')})
),
blocks AS (SELECT *, {INPUT} AS input FROM nodes WHERE json_type(x) = 'OBJECT')
"""
FOUND_SQL = TABLES_SQL + "SELECT DISTINCT conv_uuid, ordinals[1] AS msg_pos, branch, array_to_string(ordinals[2:], '.') AS node_path, field, val FROM (" + " UNION ALL ".join(
    f"SELECT *, '{name}' AS field, {leaf} AS val FROM blocks" for name, leaf in (("type", leaf_sql("x", "type")), ("text", leaf_sql("x", "text")), ("token", leaf_sql("input", "token")), ("private_runtime_url", leaf_sql("x", "private_runtime_url")))
) + ") WHERE val IS NOT NULL"


def table_sql(source: str, x: str, names: list[str], where: str = "true") -> str:
    """A pivoted table of objects with any leaf at all."""
    cells = ", ".join(f"{leaf_sql('input', *n.split('.')[1:]) if n.startswith('input.') else leaf_sql(x, *n.split('.'))} AS {n.replace('.', '_')}" for n in names)
    return TABLES_SQL + f"SELECT path, record, conv_uuid, ordinals, CASE WHEN len(ordinals) > 0 THEN ordinals[:-2] END AS parent, {cells} FROM {source} WHERE {where}"
