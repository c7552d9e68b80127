"""Arrow functions that are made when they are first used, so that modules can be imported without a session; ordered scans."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def arrow(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like pandas_udf with a type in DDL; the kind of function follows from the type hints."""

    def made(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns):
            return F.pandas_udf(f, returns)(*columns)

        return call

    return made


#: Bytes of a batch that are handled at once: what Python makes of them takes several times as much.
PART_BYTES = 4 << 20


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bounds the bytes of an Arrow batch, so that a Python worker holds little of a table with long texts at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    if int(now.rstrip("kmg")) << unit > most:
        spark.conf.set(name, str(most))


def parts_of(batches, most: int = PART_BYTES):
    """Record batches in slices of about ``most`` bytes, so that memory doesn't follow the batches' size."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most // max(batch.nbytes, most)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def in_order(rows: DataFrame, keys: list[str], order: list[str], reads: list[str], step: Callable, name: str, kind: str) -> DataFrame:
    """Adds a column that a scan of each key's rows makes: step(state or None, row) gives (state, value).

    ``row`` holds the columns ``reads``. Rows are dealt by key and sorted; a task sees one batch of them at a time and keeps
    one state, so no key is ever gathered.
    """
    names = rows.columns

    def run(batches):
        held, state = None, None
        for batch in parts_of(batches):
            values = []
            columns = [batch.column(c).to_pylist() for c in reads]
            for key, *row in zip(zip(*(batch.column(k).to_pylist() for k in keys)), *columns):
                if key != held:
                    held, state = key, None
                state, value = step(state, dict(zip(reads, row)))
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind])], [*names, name])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", {name} {kind}"
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def fold_in_order(rows: DataFrame, keys: list[str], order: list[str], reads: list[str], step: Callable, finish: Callable, fields: str) -> DataFrame:
    """The rows that a fold of each key's sorted rows gives: step(state or None, row) gives (state, list of tuples), and
    finish(state), after a key's last row, a list of tuples. Columns: the keys and ``fields`` (DDL).

    Like ``in_order``, a task sees one batch at a time and keeps one state.
    """
    schema = ", ".join(f"{rows.schema[k].name} {rows.schema[k].dataType.simpleString()}" for k in keys) + f", {fields}"

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, held, state, out = None, None, None, []

        def flush():
            nonlocal out
            done, out = out, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), kind)], schema=kind)

        for batch in parts_of(batches):
            kind = kind or to_arrow_schema(result)
            for key, *row in zip(zip(*(batch.column(k).to_pylist() for k in keys)), *(batch.column(c).to_pylist() for c in reads)):
                if key != held:
                    if held is not None:
                        out += [(*held, *x) for x in finish(state)]
                    held, state = key, None
                state, made = step(state, dict(zip(reads, row)))
                out += [(*key, *x) for x in made]
                if len(out) >= 4096:
                    yield flush()
            if out:
                yield flush()
        if held is not None:
            out += [(*held, *x) for x in finish(state)]
        if out:
            yield flush()

    from pyspark.sql.types import StructType

    result = StructType.fromDDL(schema)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, result)


def by_key(rows: DataFrame, keys: list[str], reads: list[str], run: Callable, fields: str) -> DataFrame:
    """The rows that run(list of a key's rows) gives, for keys with few rows each: without a table of its own for each key,
    which takes milliseconds."""

    def step(state, row):
        state = [] if state is None else state
        state.append(row)
        return state, []

    return fold_in_order(rows.select(*keys, *reads), keys, [], reads, step, run, fields)
