"""Operators of pipelines that call Python: batch functions and row predicates."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from functools import partial
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def _batches(parts: Iterator[pa.RecordBatch], size: int | None) -> Iterator[pa.Table]:
    """Cut and merge record batches to tables of `size` rows, the last one shorter; as they come if None."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for part in parts:
        if size is None:
            yield pa.Table.from_batches([part])
            continue
        while part.num_rows:
            take = min(size - rows, part.num_rows)
            held.append(part.slice(0, take))
            rows, part = rows + take, part.slice(take)
            if rows == size:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def map_batches(
    df: DataFrame,
    fn: Callable | type,
    schema: str | T.StructType,
    batch_size: int | None = None,
    batch_format: str = "pandas",
    fn_kwargs: dict[str, Any] | None = None,
    fn_constructor_kwargs: dict[str, Any] | None = None,
) -> DataFrame:
    """Apply a batch function; rows and columns may change, so the result's schema is given.

    `fn` takes and returns a pandas.DataFrame, or a pyarrow.Table for `batch_format` "arrow". It may be a class
    whose instances are callable: one is built at the start of each task. `batch_size` rows are passed at a time,
    the last batch of a partition may have fewer. Filters and selections belong before this operator, since
    Spark can't push them through Python.
    """
    if batch_size is not None and batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    if batch_format not in ("pandas", "arrow"):
        raise ValueError("batch_format is pandas or arrow")
    kwargs, made = dict(fn_kwargs or {}), dict(fn_constructor_kwargs or {})
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        call = partial(fn(**made) if inspect.isclass(fn) else fn, **kwargs)
        arrow = to_arrow_schema(out)
        for table in _batches(parts, batch_size):
            if batch_format == "arrow":
                result = call(table).select(arrow.names).cast(arrow)
            else:
                frame: pd.DataFrame = call(table.to_pandas(date_as_object=True))
                result = pa.Table.from_pandas(frame[arrow.names], schema=arrow, preserve_index=False)
            yield from result.to_batches()

    return df.mapInArrow(run, out)


def filter_rows(df: DataFrame, predicate: Column | str | Callable[[dict[str, Any]], bool], fn_kwargs: dict[str, Any] | None = None) -> DataFrame:
    """Keep rows: by an expression, which is pushed down to the scan, or by a Python function of a row as a dict, which isn't."""
    if not callable(predicate) or isinstance(predicate, Column):
        return df.filter(predicate)
    call = partial(predicate, **dict(fn_kwargs or {}))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array([bool(call(row)) for row in part.to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
