"""GIF images and animations in pure Python and numpy: LZW streams, palettes, disposal.

The reader follows the 89a layout: global and local palettes, sub-blocks, extensions,
interlacing, transparent index, disposal 0 to 3 and frame delays. The writer stores 8-bit
samples losslessly as the indices of a palette of 256 different colours.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

CLEAR, END, FIRST = 256, 257, 258
#: Codes in a run before its clear code: the table is then full.
RUN = 3838
WIDTH, FRAME_ROWS, DELAY_CS = 64, 256, 10
#: Three bits of red, three of green, two of blue: 256 colours that differ, so they can be told apart again.
_INDEX = np.arange(256)
PALETTE = np.stack([(_INDEX >> 5) * 36, (_INDEX >> 2 & 7) * 36, (_INDEX & 3) * 85], 1).astype(np.uint8)
#: Pixels of the largest canvas that is played; a header of 14 bytes can ask for 4 billion.
MOST_PIXELS = 1 << 26


@lru_cache(maxsize=64)
def code_places(min_bits: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes 0 .. count - 1 after a clear code, and the bits before each."""
    size = (1 << min_bits) + 1 + np.arange(count)
    widths = np.clip(np.floor(np.log2(size)).astype(np.int64) + 1, min_bits + 1, 12)
    return widths, np.cumsum(widths) - widths


def lzw_encode(samples: bytes) -> bytes:
    """LZW code stream of 8-bit samples: a clear code, runs of at most RUN codes, an end code."""
    codes: list[int] = []
    ends: list[int] = []
    append, table = codes.append, {}
    get, new, full = table.get, FIRST, FIRST + RUN - 1
    rest = iter(samples)
    prefix = next(rest, None)
    if prefix is None:
        return pack_codes(np.empty(0, np.int64), [])
    for b in rest:
        key = prefix << 8 | b
        found = get(key)
        if found is not None:
            prefix = found
            continue
        append(prefix)
        if new == full:
            ends.append(len(codes))
            table.clear()
            new = FIRST
        else:
            table[key] = new
            new += 1
        prefix = b
    append(prefix)
    return pack_codes(np.array(codes, np.int64), [*ends, len(codes)])


def pack_codes(codes: np.ndarray, ends: list[int]) -> bytes:
    """Bits of the codes with a clear code before the first run and between runs."""
    values, places, bits, begin = [np.array([CLEAR])], [np.array([0])], 9, 0
    for k, stop in enumerate(ends):
        widths, before = code_places(8, RUN + 1)
        run = stop - begin
        values += [codes[begin:stop], np.array([CLEAR if k < len(ends) - 1 else END])]
        places.append(bits + before[: run + 1])
        bits += int(before[run] + widths[run])
        begin = stop
    if not ends:
        values.append(np.array([END]))
        places.append(np.array([9]))
        bits = 18
    value, place = np.concatenate(values), np.concatenate(places)
    value, byte = value << (place & 7), place >> 3
    size = (bits + 7) // 8
    out = np.zeros(size + 3, np.int64)
    for k in range(3):  # bits of different codes are disjoint, so sums are unions
        out[k:] += np.bincount(byte, value >> 8 * k & 255, size + 3 - k).astype(np.int64)
    return out[:size].astype(np.uint8).tobytes()


def _replay(codes: list[int], clear: int) -> np.ndarray:
    """The samples that one run of codes stands for.

    Entry k of the run is code k's string and one sample more, and that string already lies
    in the output, so each code is a root or a copy of earlier output. Lengths are replayed
    in order; the copies are then resolved by pointer jumping.
    """
    lengths = [1] * clear + [0, 0]
    most, add = 4096, lengths.append
    sizes = []
    for code in codes:
        size = lengths[code]
        sizes.append(size)
        if len(lengths) < most:
            add(size + 1)
    code, size = np.array(codes, np.int64), np.array(sizes, np.int64)
    end = np.cumsum(size)
    begin = end - size
    root = code < clear
    source = np.zeros(len(code), np.int64)
    source[~root] = begin[code[~root] - clear - 2]
    place = np.arange(int(end[-1]))
    copied = np.repeat(~root, size)
    at = np.where(copied, np.repeat(source - begin, size) + place, place)
    while copied[at].any():
        at = at[at]
    owner = np.zeros(len(place), np.uint8)
    owner[begin[root]] = code[root]
    return owner[at]


def lzw_decode(stream: bytes, min_bits: int, most: int) -> bytes:
    """At most ``most`` samples of a code stream.

    A code's width depends only on how many codes came since the last clear code, so a whole
    run is cut into codes at once; the dictionary is then replayed over them.
    """
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    data = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    total = len(stream) * 8
    out, done, place, step = [], 0, 0, 4096
    while done < most:
        widths, starts = code_places(min_bits, step)
        fit = int(np.searchsorted(starts + widths, total - place, "right"))
        widths, starts = widths[:fit], starts[:fit] + place
        if not fit:
            break
        codes = data[starts >> 3] >> (starts & 7) & (1 << widths) - 1
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stops) and fit == step:
            step *= 4  # a run whose encoder kept the full table
            continue
        stop = int(stops[0]) if len(stops) else fit
        if stop:
            try:
                out.append(_replay(codes[:stop].tolist(), clear))
            except IndexError:
                raise ValueError("LZW code beyond the table") from None
            done += len(out[-1])
        if stop == fit or codes[stop] == end:
            break
        place = int(starts[stop] + widths[stop])
        step = 4096
    return np.concatenate(out)[:most].tobytes() if out else b""


def _sub_blocks(data: bytes) -> bytes:
    full = len(data) // 255
    parts = []
    for k in range(full):
        parts += [b"\xff", data[k * 255 : k * 255 + 255]]
    rest = data[full * 255 :]
    if rest:
        parts += [bytes([len(rest)]), rest]
    return b"".join([*parts, b"\0"])


def write_gif(samples: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """An animation whose frames, one after another, hold ``samples`` (a multiple of ``width``)."""
    total = len(samples) // width
    height = min(rows, total)
    u16 = lambda *x: b"".join(v.to_bytes(2, "little") for v in x)
    out = [b"GIF89a", u16(width, height), b"\xf7\0\0", PALETTE.tobytes()]
    for top in range(0, total, rows):
        tall = min(rows, total - top)
        part = samples[top * width : (top + tall) * width]
        out += [b"\x21\xf9\x04\x04", u16(delay_cs), b"\0\0", b"\x2c", u16(0, 0, width, tall), b"\0\x08", _sub_blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """One timed frame: where its own pixels lie, and the whole canvas after it is drawn."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    index: np.ndarray
    canvas: np.ndarray
    #: Whether the code stream held all of the frame's pixels; missing ones have index 0.
    complete: bool


def samples_of(colours: np.ndarray) -> bytes:
    """The samples whose palette colours fill an area, rows first."""
    c = colours.astype(np.int64)
    return (c[..., 0] // 36 << 5 | c[..., 1] // 36 << 2 | c[..., 2] // 85).astype(np.uint8).tobytes()


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        got = self.data[self.at : self.at + n]
        if len(got) < n:
            raise ValueError("GIF ends early")
        self.at += n
        return got

    def u16(self) -> int:
        return int.from_bytes(self.take(2), "little")

    def blocks(self) -> bytes:
        parts = []
        while n := self.take(1)[0]:
            parts.append(self.take(n))
        return b"".join(parts)


def _deinterlace(index: np.ndarray) -> np.ndarray:
    order = np.r_[tuple(np.arange(a, len(index), b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)))]
    out = np.empty_like(index)
    out[order] = index
    return out


def read_gif(data: bytes):
    """Yield the frames of a GIF in order, composed under disposal and transparency rules.

    One canvas is held (and a copy while a frame with disposal 3 is shown); bytes that are no
    GIF, or stop being one, raise a ValueError where they do.
    """
    r = _Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = r.u16(), r.u16(), *r.take(3)
    palette = np.frombuffer(r.take(3 << ((flags & 7) + 1)), np.uint8).reshape(-1, 3) if flags & 128 else None
    if width * height > MOST_PIXELS:
        raise ValueError(f"GIF canvas of {width} x {height}")
    canvas = np.zeros((height, width, 3), np.uint8)
    disposal, delay, clear = 0, 0, None
    while (mark := r.take(1)) != b"\x3b":
        if mark == b"\x21":
            kind, body = r.take(1), r.blocks()
            if kind == b"\xf9" and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little") * 10
                clear = body[3] if body[0] & 1 else None
            continue
        if mark != b"\x2c":
            raise ValueError("unknown GIF block")
        left, top, w, h = r.u16(), r.u16(), r.u16(), r.u16()
        flags = r.take(1)[0]
        colours = np.frombuffer(r.take(3 << ((flags & 7) + 1)), np.uint8).reshape(-1, 3) if flags & 128 else palette
        if colours is None:
            raise ValueError("GIF frame without a palette")
        min_bits = r.take(1)[0]
        if not 1 <= min_bits <= 8 or w * h > MOST_PIXELS:
            raise ValueError(f"GIF frame of {w} x {h} in {min_bits} bits")
        raw = np.frombuffer(lzw_decode(r.blocks(), min_bits, w * h), np.uint8)
        index = np.zeros(w * h, np.uint8)
        index[: len(raw)] = raw
        index = index.reshape(h, w)
        if flags & 64:
            index = _deinterlace(index)
        before = canvas.copy() if disposal == 3 else None
        high, wide = max(0, min(h, height - top)), max(0, min(w, width - left))
        area, shown = canvas[top : top + high, left : left + wide], index[:high, :wide]
        drawn = np.ones(shown.shape, bool) if clear is None else shown != clear
        area[drawn] = colours[np.minimum(shown, len(colours) - 1)][drawn]
        yield Frame(left, top, w, h, delay, disposal, index, canvas.copy(), len(raw) == w * h)
        if disposal == 2:
            canvas[top : top + high, left : left + wide] = 0
        elif before is not None:
            canvas = before
        disposal, delay, clear = 0, 0, None
