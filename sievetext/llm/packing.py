"""Best-fit packing of tokenised documents by linear grouping.

Documents become token ids (end id appended) and are cut only if longer than a sequence:
the first piece takes the remainder, the others are full. Lengths are whole numbers up to
the sequence length, so the corpus is described by one count for each length. The driver
plans on these counts alone:

1. lengths over a threshold (several are tried) are sorted and cut into ``GROUPS`` groups of equal cardinality,
   each rounded up to its largest member;
2. the few sizes are packed by a configuration linear programme (columns by knapsack);
3. the rounded-down configurations are filled with actual lengths, group by group;
4. what is left, large then small lengths, goes best-fit into the tightest gap that takes it,
   and into new sequences filled longest first.

The plan is a table of slots (length, first rank, sequences, ...), whose size depends on the
sequence length and not on the corpus. Each piece finds its slot by its rank within its
length, which is counted in buckets, so a length that most pieces share is split up.

``pack`` makes one plan for the whole corpus. ``pack_windows`` keeps an order: each run of
``WINDOW`` documents is planned and packed by itself, in one task each, and its sequences are
numbered by the mean place of what they hold, so reading sequences by id follows the order.

Null text counts as empty: one piece holding the end id alone. Repeated rows are each packed.
A very long text is tokenised whole in one task and becomes many pieces. Extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievetext.llm.arrow_tools import grouped, map_kept
from sievetext.session import cut_lineage

SEQUENCE, END_ID = 1024, 2
GROUPS = 128
#: Lengths up to which documents count as small; the plan with the fewest sequences is taken.
SMALLS = (48, 160, 420, 511)
#: Relative distance to the programme's optimum at which column generation ends.
GAP = 3e-4
ROWS_A_BUCKET = 100_000
PIECE = "piece int, start long, length long, ids_crc32 long"
#: Documents that are packed together where an order is kept.
WINDOW = 1 << 16


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a ``tokenizers`` file, run by the faster ``tiktoken`` loop.

    In these files an id is its merge's rank, which is what the loop needs; ids are the same
    (the tests hold both libraries against each other). The file's added tokens are the
    special ones.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    special = {x["content"]: x["id"] for x in vocabulary.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in token): k for token, k in vocabulary["model"]["vocab"].items() if token not in special}
    import public_tokenizers

    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(path: str, text: str | None, special: bool = False) -> np.ndarray:
    """Ids of a whole text and the end id, as little-endian 32-bit numbers.

    With ``special``, the file's added tokens get their own ids, as ``tokenizers`` does unless
    told to encode them as text.
    """
    byte_bpe, text = encoder(path), text or ""
    if special and any(s in text for s in byte_bpe.special_tokens_set):
        return np.array([*byte_bpe.encode(text, allowed_special="all"), END_ID], "<u4")
    return np.array([*byte_bpe.encode_ordinary(text), END_ID], "<u4")


def cuts(total: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with ``total`` ids."""
    first = total % sequence or sequence
    return [(0, first), *((k, sequence) for k in range(first, total, sequence))] if total > sequence else [(0, total)]


def tokenised(docs: DataFrame, path: str, keep: list[str], text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """``keep`` and ``pieces`` (piece, start, length, ids_crc32) of every whole text."""
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for value in batch.column(0):
            ids = token_ids(path, value.as_py(), special=True)
            rows.append([{"piece": n, "start": start, "length": length, "ids_crc32": zlib.crc32(ids[start : start + length].tobytes())} for n, (start, length) in enumerate(cuts(len(ids), sequence))])
        return [pa.array(rows, kind)]

    return map_kept(docs, keep, [F.col(text).cast("string")], work, f"pieces array<struct<{PIECE.replace(' ', ':').replace(',:', ',')}>>", 256)


def pieces(docs: DataFrame, path: str, keep: list[str], text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """``keep``, piece, start, length and ids_crc32 of every piece of every whole text."""
    return tokenised(docs, path, keep, text, sequence).select(*[F.col(f"`{c}`") for c in keep], F.inline("pieces"))


def _knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of the most valuable multiset of ``sizes`` within ``capacity``."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k in np.flatnonzero(value > 1e-9):
        size, worth = int(sizes[k]), value[k]
        for begin in range(size, capacity + 1, size):  # one more copy for each step
            end = min(begin + size, capacity + 1)
            more = best[begin - size : end - size] + worth
            better = more > best[begin:end] + 1e-12
            best[begin:end][better] = more[better]
            pick[begin:end][better] = k
    count, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            count[pick[room]] += 1
            room -= sizes[pick[room]]
    return count


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination without BLAS, whose threads can stall in a driver that forks."""
    n = len(matrix)
    work = np.concatenate([matrix, np.eye(n)], 1)
    for k in range(n):
        row = k + int(np.abs(work[k:, k]).argmax())
        work[[k, row]] = work[[row, k]]
        work[k] /= work[k, k]
        rest = work[:, k].copy()
        rest[k] = 0
        work -= rest[:, None] * work[k]
    return work[:, n:]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most_steps: int = 4000) -> list[tuple[np.ndarray, int]]:
    """(counts of each size, sequences), rounded down, from the configuration programme."""
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    amount = demand / columns.diagonal()
    inverse = np.diag(1 / columns.diagonal())
    for step in range(most_steps):
        price = inverse.sum(0)
        column = _knapsack(sizes, price, capacity).astype(float)
        if price @ column <= 1 + GAP:
            break
        direction = (inverse * column).sum(1)
        able = direction > 1e-9
        if not able.any():
            break
        ratio = np.where(able, amount / np.where(able, direction, 1), np.inf)
        out = int(ratio.argmin())
        amount = np.maximum(amount - ratio[out] * direction, 0)
        amount[out] = ratio[out]
        columns[:, out] = column
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        if step % 100 == 99:
            inverse = _inverse(columns)
            amount = np.maximum((inverse * demand).sum(1), 0)
    return [(columns[:, j].astype(np.int64), int(np.floor(amount[j] + 1e-6))) for j in range(k)]


class Plan:
    """Sequences as runs: (sequences alike, {length: count}, room left in each)."""

    def __init__(self, sequence: int) -> None:
        self.sequence = sequence
        self.by_room: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)

    def add(self, bins: int, held: dict[int, int]) -> None:
        if bins:
            self.by_room[self.sequence - sum(n * c for n, c in held.items())].append((bins, held))

    def best_fit(self, length: int, count: int) -> int:
        """Put items into the tightest gaps that take them; the number left over."""
        for room in range(length, self.sequence):
            while count and self.by_room.get(room):
                bins, held = self.by_room[room].pop()
                each = room // length
                full = min(bins, count // each)
                count -= full * each
                self.add(full, held | {length: held.get(length, 0) + each})
                bins -= full
                if bins and count:
                    self.add(1, held | {length: held.get(length, 0) + count})
                    bins, count = bins - 1, 0
                if bins:
                    self.by_room[room].append((bins, held))
            if not count:
                return 0
        return count

    def fill_new(self, left: dict[int, int]) -> None:
        """New sequences, each filled with the longest lengths that still fit."""
        left = {n: c for n, c in left.items() if c}
        while left:
            room, held = self.sequence, {}
            for n in sorted(left, reverse=True):
                if n <= room:
                    held[n] = min(left[n], room // n)
                    room -= n * held[n]
            bins = min(left[n] // c for n, c in held.items())
            self.add(bins, held)
            for n, c in held.items():
                left[n] -= bins * c
                if not left[n]:
                    del left[n]

    def runs(self) -> list[tuple[int, dict[int, int]]]:
        return [run for room in sorted(self.by_room) for run in self.by_room[room]]


def plan(counts: dict[int, int], sequence: int = SEQUENCE, groups: int = GROUPS, smalls: tuple[int, ...] = SMALLS) -> Plan:
    """Pack ``counts`` (length -> pieces) into few sequences."""
    return min((_plan(counts, sequence, groups, small) for small in smalls), key=lambda p: sum(bins for bins, _ in p.runs()))


def _plan(counts: dict[int, int], sequence: int, groups: int, small: int) -> Plan:
    out = Plan(sequence)
    out.add(counts.get(sequence, 0), {sequence: 1})
    large = sorted((n for n in counts if small < n < sequence and counts[n]), reverse=True)
    left: dict[int, int] = {}
    if large:
        total = sum(counts[n] for n in large)
        each = -(-total // groups)
        queues: list[list[list[int]]] = [[]]
        room = each
        for n in large:
            rest = counts[n]
            while rest:
                if not room:
                    queues.append([])
                    room = each
                take = min(rest, room)
                queues[-1].append([n, take])
                rest, room = rest - take, room - take
        top = np.array([q[0][0] for q in queues])
        sizes, group_of = np.unique(top, return_inverse=True)
        pools: list[list[list[int]]] = [[] for _ in sizes]
        for q, k in zip(queues, group_of):
            pools[k] += q
        demand = np.array([sum(c for _, c in p) for p in pools], float)
        for config, bins in configurations(sizes, demand, sequence):
            slots = [k for k in np.flatnonzero(config) for _ in range(config[k])]
            if not bins or not slots:
                continue
            bins = min([bins, *(sum(c for _, c in pools[k]) // int(config[k]) for k in set(slots))])
            _substitute(out, pools, slots, bins)
        for p in pools:
            for n, c in p:
                left[n] = left.get(n, 0) + c
    for n in sorted(n for n in counts if n <= small and counts[n]):
        left[n] = left.get(n, 0) + counts[n]
    rest = {}
    for n in sorted(left, reverse=True):
        if c := out.best_fit(n, left[n]):
            rest[n] = c
            if n > sequence // 2:
                out.add(c, {n: 1})
                del rest[n]
            elif n > small:
                out.fill_new(rest)
                rest = {}
    out.fill_new(rest)
    return out


def _substitute(out: Plan, pools: list[list[list[int]]], slots: list[int], bins: int) -> None:
    """Fill ``bins`` sequences of one configuration with actual lengths, in runs alike."""
    taken: list[list[list[int]]] = []
    for k in slots:
        need, got = bins, []
        while need:
            n, c = pools[k][-1]
            take = min(c, need)
            got.append([n, take])
            need -= take
            if take == c:
                pools[k].pop()
            else:
                pools[k][-1][1] -= take
        taken.append(got)
    while bins:
        alike = min(got[-1][1] for got in taken)
        held: dict[int, int] = {}
        for got in taken:
            held[got[-1][0]] = held.get(got[-1][0], 0) + 1
            got[-1][1] -= alike
            if not got[-1][1]:
                got.pop()
        out.add(alike, held)
        bins -= alike


def slot_table(packed: Plan) -> np.ndarray:
    """Rows (length, first rank, first sequence, items of the length a sequence, offset)."""
    rows, rank, sequence = [], defaultdict(int), 0
    for bins, held in packed.runs():
        offset = 0
        for n in sorted(held, reverse=True):
            rows.append((n, rank[n], sequence, held[n], offset))
            rank[n] += bins * held[n]
            offset += n * held[n]
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(table: DataFrame, total: int) -> DataFrame:
    """``table`` with ``rank``, from 0 within each length; buckets split frequent lengths."""
    buckets = max(16, min(1 << 16, total // ROWS_A_BUCKET))
    dealt = table.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("__row", F.row_number().over(within) - 1)
    return numbered.join(counts, ["length", "__bucket"]).withColumn("rank", F.col("__before") + F.col("__row")).drop("__bucket", "__row", "__before")


def places(slots: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces of these lengths and ranks."""
    keys = slots[:, 0] << 44 | slots[:, 1]
    at = slots[np.searchsorted(keys, length << 44 | rank, "right") - 1]
    index = rank - at[:, 1]
    return at[:, 2] + index // at[:, 3], at[:, 4] + index % at[:, 3] * length


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = cut_lineage(pieces(docs, path, ["doc_id"], sequence=sequence))
    counts = {int(r["length"]): r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(slot_table(plan(counts, sequence)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, offset = places(shared.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked(cut, sum(counts.values())).mapInArrow(run, f"doc_id {kind}, {PIECE}, sequence_id long, offset long")


def pack_windows(docs: DataFrame, order: str, sequence: int = SEQUENCE, window: int = WINDOW) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and the order of every piece.

    ``docs`` are (doc_id, pieces, ``order``), the order being whole numbers from 0, each once.
    A document has at most one piece shorter than a sequence, so a window's plan holds at most
    ``window`` pieces; full pieces are sequences of their own. A sequence's id is its window, the
    mean place of its pieces there, and a number that tells it from others at that place.
    """
    rows = docs.select("doc_id", F.col(order).alias("mix_order"), F.inline("pieces"))
    place, at = F.col("mix_order") % window, F.floor(F.col("mix_order") / window).cast("long")
    full = rows.where(F.col("length") == sequence).withColumn("sequence_id", F.shiftleft(at, 40).bitwiseOR(F.shiftleft(place.cast("long"), 24)).bitwiseOR(F.lit(1 << 23)).bitwiseOR(F.col("piece").cast("long"))).withColumn("offset", F.lit(0).cast("long"))
    short = rows.where(F.col("length") < sequence).withColumn("window", at)
    tasks = max(1, -(-docs.count() // window))
    names = ["doc_id", "mix_order", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["window"]):
            length, place = table["length"].to_numpy(), table["mix_order"].to_numpy() % window
            values, counts = np.unique(length, return_counts=True)
            slots = slot_table(plan(dict(zip(values.tolist(), counts.tolist())), sequence))
            by_length = np.lexsort((place, length))
            rank = np.empty(len(length), np.int64)
            rank[by_length] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
            at, offset = places(slots, length, rank)
            mean = np.bincount(at, place) // np.maximum(np.bincount(at), 1)
            ids = table["window"].to_numpy() << 40 | mean[at].astype(np.int64) << 24 | at
            yield from pa.table([*(table[c] for c in names), pa.array(ids), pa.array(offset)], [*names, "sequence_id", "offset"]).combine_chunks().to_batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = short.repartition(tasks, "window").sortWithinPartitions("window", "mix_order")
    packed = dealt.mapInArrow(run, f"doc_id {kind}, mix_order long, {PIECE}, sequence_id long, offset long")
    return packed.unionByName(full).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "mix_order")
