"""Exact top-k search by integer inner product: ball-tree branch and bound on shards.

Vectors are quantised to floor(64 x) for each component; each row gets a key of its own.

1. Of equal vectors only the k + 1 rows with the smallest ids can be in any answer, so only
   they are searched; equal queries are searched once. Hot vectors thus cost no more than others.
2. A ball tree over a bounded sample gives at most ``MOST_CELLS`` cells. Every row goes to its
   nearest cell; a cell is cut into shards of about ``SHARD_BYTES`` by a hash of the key.
3. Each query goes to one shard of the cell with its highest bound q.c + |q| r. The kth score
   found there goes with the query to all other shards of cells whose bound reaches it.
4. A task builds its shard's tree once and lets the queries stream past, in blocks; beyond
   ``QUERY_ROWS`` queries a shard goes to several tasks. Nodes are visited by falling bound and
   left when no member can enter, which for a bound equal to the kth score also looks at the
   node's smallest id.
5. The best k + 1 of all shards, less the query's own row, are the answer.

Every score is exact: products are summed in 64-bit floats while they stay below 2^53, else
in 64-bit integers, else in Python integers, and a score beyond 64 bits raises. Vectors of
different lengths are compared as if padded by zeros. Vectors that are null, or hold null
or non-finite components, take no part, nor do rows with a null id. Rows with equal ids are
different rows: each is a candidate, each query among them gets its own answer, and only its
own row is left out of it. Ties go to the smaller id; fewer than k candidates are all
returned. Extra columns are ignored; an empty table or query set gives an empty result.
Very long vectors make shards of fewer rows; a task holds one shard and one block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievetext.llm.sampling import hashed_share
from sievetext.session import cut_lineage

SCALE, K, LEAF = 64, 20, 96
#: Bytes of a shard's vectors, and of the sample that the cells come from.
SHARD_BYTES, SAMPLE_BYTES = 4 << 20, 4 << 20
MOST_CELLS = 256
#: Queries that meet a shard in one task, and those that are searched together.
QUERY_ROWS, BLOCK = 65_536, 512
#: Tasks of one search; with more groups than that a task takes several in turn.
MOST_TASKS = 1 << 17
#: Parts into which the rows of one query vector are split when answers are handed out.
SALTS = 16
NONE, LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def quantised(vectors: DataFrame, asked: Column, id_column: str, vector: str) -> DataFrame:
    """(key, id, v, asked): whole-number components, as 64-bit floats, of the rows that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double") * SCALE)
    x = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c))
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    usable = vectors.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).where(fine)
    return usable.select(F.monotonically_increasing_id().alias("key"), F.col(id_column).cast("long").alias("id"), x.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of ``width`` columns, shorter ones padded by zeros."""
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)
    out = np.zeros((len(size), width))
    rows = np.repeat(np.arange(len(size)), size)
    out[rows, np.arange(len(flat)) - np.repeat(offsets[:-1], size)] = flat
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows as 64-bit integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    left, right = ([[int(x) for x in row] for row in m] for m in (a, b))
    out = [[sum(p * q for p, q in zip(u, v)) for v in right] for u in left]
    if any(abs(s) >= 2**63 for row in out for s in row):
        raise OverflowError("an inner product exceeds 64 bits")
    return np.array(out, np.int64).reshape(len(a), len(b))


class BallTree:
    """Rows in tree order; each node is (begin, end, centre, radius, smallest id, left, right)."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, points: np.ndarray, leaf: int | None = None) -> None:
        order = np.lexsort((keys, ids))
        self.ids, self.keys, self.points = ids[order], keys[order], points[order]
        self.leaf = leaf or LEAF
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int, int]] = []
        if len(ids):
            self._build(0, len(ids))

    def _build(self, begin: int, end: int) -> int:
        """Split along the line between two far points; the number of the node."""
        part = self.points[begin:end]
        centre = part.mean(0)
        away = ((part - centre) ** 2).sum(1)
        radius = float(np.sqrt(away.max())) * (1 + 1e-9) + 1e-9
        here = len(self.nodes)
        self.nodes.append((begin, end, centre, radius, int(self.ids[begin:end].min()), -1, -1))
        if end - begin > self.leaf and away.max() > 0:
            far = part[away.argmax()]
            other = part[((part - far) ** 2).sum(1).argmax()]
            order = np.argsort(part @ (other - far), kind="stable")
            for rows in (self.points, self.ids, self.keys):
                rows[begin:end] = rows[begin:end][order]
            middle = (begin + end) // 2
            left, right = self._build(begin, middle), self._build(middle, end)
            self.nodes[here] = (*self.nodes[here][:5], left, right)
        return here

    def leaves(self) -> np.ndarray:
        """Centres of the leaves."""
        return np.array([n[2] for n in self.nodes if n[5] < 0])

    def search(self, best: Best) -> None:
        """Let every row that can enter a query's best do so."""
        if not self.nodes:
            return
        every = np.arange(len(best.queries))
        stack = [(0, every, self._bound(0, best, every))]
        while stack:
            node, who, bound = stack.pop()
            begin, end, _, _, least, left, right = self.nodes[node]
            kth, worst = best.score[who, -1], best.found[who, -1]
            open_ = (bound >= best.floor[who]) & ((bound > kth) | ((bound >= kth) & (least <= worst)))
            who = who[open_]
            if not len(who):
                continue
            if left < 0:
                best.offer(who, self.ids[begin:end], self.keys[begin:end], self.points[begin:end])
                continue
            sides = [(child, who, self._bound(child, best, who)) for child in (left, right)]
            sides.sort(key=lambda s: float(s[2].sum()))
            stack += sides

    def _bound(self, node: int, best: Best, who: np.ndarray) -> np.ndarray:
        return highest(best.queries[who], self.nodes[node][2], self.nodes[node][3], best.norms[who])


def norms_of(queries: np.ndarray) -> np.ndarray:
    return np.sqrt((queries**2).sum(1)) * (1 + 1e-9)


def highest(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray | float, norms: np.ndarray) -> np.ndarray:
    """The largest whole inner product that a member of a ball can have."""
    bound = queries @ centre + norms * radius
    return np.floor(bound + 1e-6 * np.abs(bound) + 1e-6)


class Best:
    """The best rows of each query so far, by score, then smaller id, then key; none under ``floor``."""

    def __init__(self, queries: np.ndarray, floor: np.ndarray, most: int) -> None:
        self.queries, self.norms, self.floor = queries, norms_of(queries), floor
        self.score = np.full((len(queries), most), LEAST)
        self.found, self.key = np.full((len(queries), most), NONE), np.full((len(queries), most), NONE)

    def offer(self, who: np.ndarray, ids: np.ndarray, keys: np.ndarray, points: np.ndarray) -> None:
        most, shape = self.score.shape[1], (len(who), len(ids))
        score = np.concatenate([self.score[who], exact_products(self.queries[who], points)], 1)
        found = np.concatenate([self.found[who], np.broadcast_to(ids, shape)], 1)
        key = np.concatenate([self.key[who], np.broadcast_to(keys, shape)], 1)
        order = np.lexsort((key, found, -np.maximum(score, LEAST + 1)), axis=1)[:, :most]
        for kept, new in ((self.score, score), (self.found, found), (self.key, key)):
            kept[who] = np.take_along_axis(new, order, 1)


def _search_task(most: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each (shard, part) is a run of rows, the shard's (kind 0) before the queries (kind 1)."""
        tree, group, rows = None, None, []
        for batch in batches:
            shard, part, kind = (batch.column(c).to_numpy() for c in ("shard", "part", "kind"))
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for begin, end in zip([0, *edges], [*edges, batch.num_rows]):
                if begin == end:
                    continue
                if (shard[begin], part[begin]) != group:
                    tree, group, rows = None, (shard[begin], part[begin]), []
                piece = batch.slice(begin, end - begin)
                if not kind[begin]:
                    rows.append((piece.column("id").to_numpy(), piece.column("key").to_numpy(), matrix_of(piece.column("v"), width)))
                    continue
                if tree is None:
                    tree = BallTree(*(np.concatenate(x) for x in zip(*rows))) if rows else BallTree(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width)))
                    rows = []
                for at in range(0, piece.num_rows, BLOCK):
                    queries = piece.slice(at, BLOCK)
                    floor = queries.column("floor").fill_null(LEAST).to_numpy()
                    best = Best(matrix_of(queries.column("v"), width), floor, most)
                    tree.search(best)
                    there = (best.found != NONE) & (best.score >= floor[:, None])
                    qid = queries.column("key").to_numpy()[np.nonzero(there)[0]]
                    yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(best.key[there]), pa.array(best.found[there]), pa.array(best.score[there])], ["qid", "key", "id", "score"])

    return run


def _searched(shards: DataFrame, asks: DataFrame, most: int, width: int) -> DataFrame:
    """qid, key, id, score of what each asked shard finds; ``asks`` are (shard, qid, v, floor)."""
    load = cut_lineage(asks.groupBy("shard").agg(F.count(F.lit(1)).alias("asked")).select("shard", F.ceil(F.col("asked") / QUERY_ROWS).cast("int").alias("parts")))
    groups = load.agg(F.sum("parts")).first()[0] or 1
    rows = shards.join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "key", "id", "v", F.lit(None).cast("long").alias("floor"))
    asked = asks.join(load, "shard").select("shard", F.pmod(F.xxhash64(F.lit(7), "qid"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("qid").alias("key"), F.lit(0).cast("long").alias("id"), "v", "floor")
    both = rows.unionByName(asked).repartition(min(groups, MOST_TASKS), "shard", "part").sortWithinPartitions("shard", "part", "kind", "key")
    return both.mapInArrow(_search_task(most, width), "qid long, key long, id long, score long")


def _cells(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """Centres of the cells, from a sample whose size does not depend on the table's."""
    bytes_a_row = 8 * max(width, 1)
    wanted = max(16, SAMPLE_BYTES // bytes_a_row)
    sample = hashed_share(rows, F.col("key"), wanted).orderBy(F.xxhash64("key"), "key").limit(wanted).select("v").toArrow()["v"].combine_chunks()
    if not len(sample):
        return np.zeros((1, width))
    points, count = matrix_of(sample, width), max(1, min(MOST_CELLS, -(-n * bytes_a_row // SHARD_BYTES)))
    zeros = np.zeros(len(points), np.int64)
    return BallTree(zeros, zeros, points, -(-len(points) // count)).leaves()


def _assign(centres, width: int):
    """Nearest cell of each row, and how far its centre is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                points = matrix_of(part.column("v"), width)
                cell = ((c**2).sum(1)[None, :] - 2 * points @ c.T).argmin(1)
                away = np.sqrt(((points - c[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(away)], ["key", "id", "v", "cell", "away"])

    return run


def _spread(cells, width: int, home: bool):
    """The shards to ask: the home shard, or all others that can hold a row at the floor or over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, first, shards = cells.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                queries, qid = matrix_of(part.column("v"), width), part.column("qid").to_numpy()
                bound = highest(queries, centres.T, radius[None, :], norms_of(queries)[:, None])
                top = np.where(shards > 0, bound, -np.inf).argmax(1)
                own = first[top] + qid % np.maximum(shards[top], 1)
                if home:
                    row, shard = np.arange(len(qid)), own
                else:
                    floor = part.column("floor").fill_null(LEAST).to_numpy()
                    row, cell = np.nonzero((bound >= floor[:, None]) & (shards > 0)[None, :])
                    each = shards[cell]
                    row = np.repeat(row, each)
                    shard = np.repeat(first[cell], each) + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                    other = shard != own[row]
                    row, shard = row[other], shard[other]
                for at in range(0, len(row), 4096):
                    taken = part.take(pa.array(row[at : at + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(shard[at : at + 4096], pa.int64()), *taken.columns], ["shard", "qid", "v", "floor"])

    return run


def top_k(vectors: DataFrame, asked: Column, k: int = K, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows for each row that is ``asked``."""
    spark, most = vectors.sparkSession, k + 1
    rows = cut_lineage(quantised(vectors, asked, id_column, vector))
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    alike = Window.partitionBy("v").orderBy("id", "key")
    reps = rows.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= most).select("key", "id", "v")
    owners = rows.where("asked").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    salted = owners.groupBy("v", "salt").agg(F.min("key").alias("qid"))
    asks = cut_lineage(salted.groupBy("v").agg(F.min("qid").alias("qid"), F.collect_set("salt").alias("salts")))

    centres = spark.sparkContext.broadcast(_cells(rows, n, width))
    placed = cut_lineage(reps.mapInArrow(_assign(centres, width), "key long, id long, v array<double>, cell int, away double"))
    count = len(centres.value)
    radius, shards = np.zeros(count), np.zeros(count, np.int64)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect():
        radius[r["cell"]], shards[r["cell"]] = r["away"] * (1 + 1e-9) + 1e-9, -(-r["n"] * 8 * max(width, 1) // SHARD_BYTES)
    first = np.cumsum(shards) - shards
    cells = spark.sparkContext.broadcast((centres.value, radius, first, shards))
    table = F.array(*[F.struct(F.lit(int(a)).alias("first"), F.lit(int(b)).alias("shards")) for a, b in zip(first, shards)])[F.col("cell")]
    placed = placed.withColumn("at", table).select((F.col("at.first") + F.pmod(F.xxhash64("key"), F.col("at.shards"))).cast("long").alias("shard"), "key", "id", "v")

    kind = "shard long, qid long, v array<double>, floor long"
    plain = asks.select("qid", "v", F.lit(None).cast("long").alias("floor"))
    near = cut_lineage(_searched(placed, plain.mapInArrow(_spread(cells, width, True), kind), most, width))
    floors = near.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") == most).select("qid", "floor")
    bounded = cut_lineage(asks.join(floors, "qid", "left").select("qid", "v", "floor"))
    far = _searched(placed, bounded.mapInArrow(_spread(cells, width, False), kind), most, width)

    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id", "key")
    best = near.unionByName(far).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    lists = best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n", "key", "id", "score"))).alias("best"))
    answers = asks.select("qid", "v", F.explode("salts").alias("salt")).join(lists, "qid").drop("qid")
    out = owners.select(F.col("key").alias("own"), F.col("id").alias("query_id"), "v", "salt").join(answers, ["v", "salt"])
    out = out.select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["key"] != F.col("own")), 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


#: DuckDB SQL for the query over ``embeddings``.
ORACLE = f"""
WITH usable AS MATERIALIZED (
  SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.key AS own, q.vec_id AS query_id, c.key AS key, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q, usable c WHERE q.vec_id % 20 = 0 AND c.key <> q.key
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id, key) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= {K}
"""
