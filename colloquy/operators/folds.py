"""Ordered folds: a running state over sorted rows, in constant memory, for what no window frame expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from colloquy.common import spread

#: Indices of a conversation are worked on in blocks of 4096, so that a hot conversation is many groups.
BLOCK_BITS = 12


def arrow_types(schema: str) -> tuple[list[str], list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return arrow.names, arrow.types


def running(rows: DataFrame, key: str, order: list[str], value: str, step: Callable[[object, object], tuple[object, int]], name: str) -> DataFrame:
    """``rows`` with a long column ``name``: ``step(state, row's value)`` gives the next state and the column; the state is None at each new key.

    The rows of a key are sorted in one partition, which spills, and streamed; none are held.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, first = None, None, True
        for batch in batches:
            out = []
            for k, v in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist()):
                if first or k != current:
                    current, state, first = k, None, False
                state, x = step(state, v)
                out.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, name])

    sorted_rows = spread(rows, key).sortWithinPartitions(key, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return sorted_rows.mapInArrow(run, f"{fields}, {name} long")


def folded(rows: DataFrame, key: str, order: list[str], values: list[str], fold: Callable[[], object], schema: str) -> DataFrame:
    """Rows made of each key's sorted rows: ``fold()`` gives an object with ``add(*values)`` and ``rows()``, tuples of the schema behind the key.

    The rows of a key are streamed through the object; what it holds is up to it.
    """
    kind = rows.schema[key].dataType.simpleString()
    names, types = arrow_types(f"{key} {kind}, {schema}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []
        for batch in batches:
            for k, *v in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or k != current:
                    if state is not None:
                        out += [(current, *r) for r in state.rows()]
                    current, state = k, fold()
                state.add(*v)
            yield arrow(out)
            out = []
        yield arrow([(current, *r) for r in state.rows()] if state is not None else [])

    def arrow(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(names), types)], names)

    ordered = spread(rows.select(key, *order, *values), key).sortWithinPartitions(key, *order).select(key, *values)
    return ordered.mapInArrow(run, f"{key} {kind}, {schema}")
