"""Media columns: whole texts stored as GIF animations, and features of their frames.

``encode`` stores each payload (UTF-8 text, zero bytes up to a positive multiple of 64) as a
GIF of 64-sample rows, 256 rows a frame, in a binary column. ``play`` reads any GIF column: it
decodes the code streams, plays the frames under palette, disposal and transparency rules, and
returns one struct for each frame, with its place, delay and an 8-bin histogram of the canvas
for each colour channel; digests of the stored bytes and of the samples read back from the
colours drawn; and what was wrong. ``decode`` is its frames and errors alone.

Null text counts as empty and is one row of zero bytes. Equal texts give equal bytes. A null
media value has no frames, null digests and no error. Bytes that are no GIF, that end early or
that ask for a canvas over ``gif.MOST_PIXELS`` fail only their own row: ``error`` says why, the
frames before that are kept, and a frame whose stream was short is marked. Frames are played
one at a time, so a very long text costs its stored bytes, its samples and one canvas. Extra
columns are ignored, whatever their names; repeated rows are each returned; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetext.llm import gif
from sievetext.llm.arrow_tools import map_kept

BLOCK = 64
BINS = 8
CHANNELS = ("red", "green", "blue")
_NUMBERS = ("left", "top", "width", "height", "delay_ms", "disposal")
FRAME = "struct<" + ",".join([f"{n}:int" for n in _NUMBERS] + ["complete:boolean"] + [f"{c}:array<long>" for c in CHANNELS]) + ">"
_ARROW = pa.list_(pa.struct([(n, pa.int32()) for n in _NUMBERS] + [("complete", pa.bool_())] + [(c, pa.list_(pa.int64())) for c in CHANNELS]))
#: Texts that are encoded before their bytes are handed on.
ROWS = 64


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % BLOCK or (0 if data else BLOCK))


def histogram(canvas: np.ndarray) -> list[list[int]]:
    """Counts of each channel's values in BINS equal bins."""
    return [np.bincount(canvas[:, :, c].ravel() >> 5, minlength=BINS).tolist() for c in range(3)]


def played(media: bytes) -> tuple[list[dict], bytes, str | None]:
    """The frames, the samples that their colours stand for, and what went wrong."""
    frames, samples, error = [], [], None
    try:
        for k, f in enumerate(gif.read_gif(media)):
            frames.append({n: getattr(f, n) for n in (*_NUMBERS, "complete")} | dict(zip(CHANNELS, histogram(f.canvas))))
            samples.append(gif.samples_of(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width]))
            if not f.complete and error is None:
                error = f"the code stream of frame {k} ends early"
    except ValueError as e:
        error = str(e)
    return frames, b"".join(samples), error


def encode(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``media``, the GIF of each whole text."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([gif.write_gif(payload(t.as_py())) for t in batch.column(0)], pa.binary())]

    return map_kept(docs, keep, [F.col(text).cast("string")], work, "media binary", ROWS)


def play(table: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """``keep``, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, frames, error."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), _ARROW, pa.string())

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for value in batch.column(0):
            stored = value.as_py()
            if stored is None:
                rows.append((None, None, None, None, None, [], None))
                continue
            frames, back, error = played(stored)
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), frames, error))
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

    out = f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<{FRAME}>, error string"
    return map_kept(table, keep, [F.col(f"`{media}`")], work, out, ROWS)


def decode(table: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """``keep``, ``frames`` (timing, place and colour histograms of every frame, in order) and ``error``."""
    return play(table, keep, media).select(*[F.col(f"`{c}`") for c in keep], "frames", "error")


def summary(frames: Column) -> Column:
    """Histograms over all frames, their number and their duration, as text."""
    none = F.array(*[F.lit(0).cast("long")] * BINS)
    total = lambda c: F.aggregate(F.transform(frames, lambda f: f[c]), none, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    bins = [F.concat(F.lit(f"{c}="), F.array_join(F.transform(total(c), lambda x: x.cast("string")), ",")) for c in CHANNELS]
    ms = F.aggregate(frames, F.lit(0).cast("long"), lambda s, f: s + f["delay_ms"])
    return F.concat_ws(";", *bins, F.concat(F.lit("frames="), F.size(frames).cast("string")), F.concat(F.lit("ms="), ms.cast("string")))
