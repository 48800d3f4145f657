"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def list_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column with one entry per array."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows that agree on ``keys``; holds one group and one batch at a time."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table[k].to_numpy() for k in keys]
        change = np.zeros(table.num_rows, bool)
        for values in columns:
            change[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for begin, end in zip(starts, starts[1:]):
            key = tuple(values[begin] for values in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(begin, end - begin))
            last = key
    if held:
        yield pa.concat_tables(held)


def map_kept(docs: DataFrame, keep: list[str], inputs: list[Column], work: Callable[[pa.RecordBatch], list[pa.Array]], out: str, rows: int) -> DataFrame:
    """``docs``' columns ``keep`` and the columns that ``work`` makes from ``inputs``, ``rows`` rows at a time.

    ``out`` is the schema of the new columns. The kept ones travel under other names, so theirs
    may clash with any and hold dots.
    """
    places = [f"__kept{k}" for k in range(len(keep))]
    table = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(keep, places)], *[c.alias(f"__in{k}") for k, c in enumerate(inputs)])
    # as a schema object: types written as text can't hold field names with dots
    schema = StructType([*table.schema.fields[: len(keep)], *StructType.fromDDL(out).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                made = work(part.select(list(range(len(places), part.num_columns))))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(places)], *made], names)

    return table.mapInArrow(run, schema).toDF(*keep, *names[len(keep) :])
