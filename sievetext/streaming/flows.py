"""Structured Streaming forms of the operators: the same expressions on unbounded input."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievetext.operators import guard, pii
from sievetext.plans.dictionaries import DictionaryReloader
from sievetext.sources import jsonrpc


def scan_stream(stream: DataFrame, rules: guard.Guard = guard.Guard(), text: str = "text") -> DataFrame:
    """Each record scanned by itself."""
    return guard.scan(stream, rules, text=text)


def sanitize_stream(stream: DataFrame, rules: guard.Guard = guard.Guard(), text: str = "text") -> DataFrame:
    return guard.scan(stream, rules, text=text).withColumn(text, F.col("sanitized")).select(*stream.columns)


def redact_stream(stream: DataFrame, policy: pii.Policy = pii.Policy(), text: str = "text") -> DataFrame:
    """Each record redacted whole, so no hit is ever cut by a window."""
    return pii.redact(stream, policy, text)


def redact_message_stream(stream: DataFrame, policy: pii.Policy = pii.Policy(), text: str = "value") -> DataFrame:
    """One JSON-RPC message a record, redacted."""
    return jsonrpc.redact_messages(stream, policy, text)


def chunk_windows(stream: DataFrame, size: int = 1024, overlap: int = 128, key: str = "stream_id", order: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Chunks of each stream joined and cut anew into windows of ``size`` that overlap.

    The state of a stream is its unfinished tail and the position of its start. Rows of a
    micro-batch are taken in ``order``. The tail is emitted when a row's chunk is null, the
    end mark.
    """
    advance = size - overlap

    def step(key_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        buffer, position, count = state.get if state.exists else ("", 0, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for value in rows[chunk]:
            ended = value is None or value is pd.NA or (isinstance(value, float) and value != value)
            buffer += "" if ended else value
            while len(buffer) >= size:
                out.append((key_[0], count, position, buffer[:size], False))
                buffer, position, count = buffer[advance:], position + advance, count + 1
            if ended:
                out.append((key_[0], count, position, buffer, True))
                buffer, position, count = "", position + len(buffer), count + 1
        state.update((buffer, position, count))
        yield pd.DataFrame(out, columns=["stream_id", "window", "position", "text", "is_last"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"stream_id {kind}, window long, position long, text string, is_last boolean", "buffer string, position long, count long", "append", "NoTimeout")


def chunk_summary(scanned: DataFrame, by: list[str] = (), threshold: float = 60) -> DataFrame:
    """Chunks, dangerous ones, mean and highest risk, matches, and whether the mean is safe."""
    out = scanned.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(~F.col("safe")).alias("dangerous"), F.round(F.avg("risk"), 2).alias("average_risk"), F.max("risk").alias("highest_risk"), F.sum(F.size("matches")).alias("matches"))
    return out.withColumn("safe", F.col("average_risk") < threshold)


def scan_windows(stream: DataFrame, rules: guard.Guard = guard.Guard(), size: int = 1024, overlap: int = 128, **columns) -> DataFrame:
    """Matches of every stream by their place in the whole stream, each told once.

    Chunks are joined into overlapping windows; a match is told by the window in whose part before
    the next window's start it begins, so none is cut (up to ``overlap`` characters) or told twice.
    """
    # the filter makes rows that a Python function takes; those of a stateful one it doesn't
    windows = chunk_windows(stream, size, overlap, **columns).where("window >= 0")
    found = guard.scan(windows, replace(rules, sanitize=False, separate=False))
    rows = found.select("stream_id", "window", "position", "is_last", F.explode_outer("matches").alias("m")).where("m IS NOT NULL")
    own = F.col("is_last") | (F.col("m.index") < size - overlap)
    return rows.where(own).select("stream_id", "window", (F.col("position") + F.col("m.index")).alias("index"), *[F.col(f"m.{c}").alias(c) for c in ("pattern", "match", "severity", "category", "confidence")])


def redact_with_reload(stream: DataFrame, reloader: DictionaryReloader, sink: Callable[[DataFrame, int], None], text: str = "text"):
    """Redact each micro-batch under the dictionaries that are current when it starts."""

    def batch(df: DataFrame, number: int) -> None:
        sink(pii.redact(df, reloader.current(df.sparkSession), text), number)

    return stream.writeStream.foreachBatch(batch)


def joined(chunks: DataFrame, by: list[str], order: str = "position", chunk: str = "chunk") -> DataFrame:
    """The text of each stream put together again from its chunks."""
    return chunks.groupBy(*by).agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(chunk)))), lambda c: c[chunk])).alias("text"))


def latest(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The last ``most`` rows by a time."""
    return rows.orderBy(F.desc(by)).limit(most)


def route(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Safe and unsafe records, for two sinks."""
    return scanned.where("safe"), scanned.where("NOT safe")
