"""Spans over whole texts: shared output form of the PII and secret operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetext.llm.arrow_tools import map_kept

#: (kind, start, end, base, score); code points, end exclusive.
Span = tuple[str, int, int, bool, float]
SPARK = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))
NAMES = ("kind", "start", "end", "base", "score")
#: Texts that are held as Python strings at a time.
TEXTS = 512


def map_spans(docs: DataFrame, find: Callable[[list[str]], list[list[Span]]], keep: list[str], text: str = "text") -> DataFrame:
    """``docs``' columns ``keep`` and ``spans`` of each whole text (null: empty)."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        found = find([t or "" for t in batch.column(0).to_pylist()])
        return [pa.array([[dict(zip(NAMES, s)) for s in x] for x in found], ARROW)]

    return map_kept(docs, keep, [F.col(text).cast("string")], work, f"spans {SPARK}", TEXTS)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def digest(spans: Column) -> Column:
    """SHA-256 of the base spans as written."""
    return F.sha2(written(F.filter(spans, lambda s: s["base"])), 256)
