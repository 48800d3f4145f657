"""Mixing sources to target weights by proportionate-fair scheduling, in DataFrame functions.

Each source's documents, in the order of a hash of their ids, form blocks of ``block_docs``. A
source with weight u of U in all has windows from that exact ratio: its block k (from 1) may not
start before slot floor((k - 1) * U / u) and must run before slot ceil(k * U / u). In each slot
the released block with the earliest deadline runs. Unit jobs with such windows always fit, so
until a source is used up it has run, after every slot of the whole run, within one block of its
target. Nothing is rounded and nothing repeats, so no drift builds up. A used-up source leaves
its slots to released blocks or empty; the others keep their proportions.

Weights are those given, as exact decimals, or whole numbers floor(1000 * sqrt(rows)) by default.
Sources with weight 0 or without one are not in the mixture: their blocks follow after its end.

The schedule is one row's fold over all blocks. It is bounded: a block holds ``BLOCK_DOCS``
documents, or so many more that there are about ``MOST_BLOCKS`` blocks in all (and one more for
each source), whatever the number of documents. Ranks within a source are counted in 4096 hash
buckets and then offset, so a source with a third of all rows is spread over all tasks.

A null source counts as the source named by the empty string. Rows with equal or null ids are
all kept, each with its own place. Extra columns are kept, whatever their names, dots included.
Texts are carried along and never looked at, however long. An empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DOCS, MOST_BLOCKS = 32, 1 << 14
#: Given weights are whole numbers of at most so much; finer ones are rounded to that.
FINEST = 1 << 40
#: Steps after which the fold hands on what it has planned.
CHUNK = 128
#: Sources whose schedule (some 60 bytes a block) is sent to every executor; with more, the
#: join is a shuffle.
BROADCAST_SOURCES = 50_000


def _source(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def block_size(rows: int) -> int:
    """Documents of a block in a corpus of so many."""
    return max(BLOCK_DOCS, -(-rows // MOST_BLOCKS))


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The same ratios in whole numbers; negative weights raise."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("a weight is negative")
    unit = lcm(*(w.denominator for w in exact.values())) if exact else 1
    top = max((w * unit for w in exact.values()), default=0)
    scale = Fraction(FINEST, int(top)) if top > FINEST else 1
    return {k: round(w * unit * scale) for k, w in exact.items()}


def shares(docs: DataFrame, source: str, weights: dict[str, float] | None, block_docs: int) -> DataFrame:
    """One row: ``shares``, the sorted array of (source, u, b, n): its weight, blocks and documents."""
    sizes = docs.groupBy(_source(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        u = F.floor(F.sqrt("n") * 1000)
    elif whole := whole_weights(weights):
        u = F.coalesce(F.create_map(*[F.lit(x) for kv in whole.items() for x in kv])[F.col("source")], F.lit(0))
    else:
        u = F.lit(0)
    return sizes.agg(F.sort_array(F.collect_list(F.struct("source", u.cast("long").alias("u"), F.ceil(F.col("n") / block_docs).cast("long").alias("b"), "n"))).alias("shares"))


#: State: ``t``, the next slot; ``done``, the blocks each source has run; ``plan``, what ran so far.
_SCHEDULE = f"""
aggregate(
  sequence(0L, (blocks - 1) div {CHUNK}),
  named_struct('t', 0L, 'done', transform(shares, x -> 0L), 'plan', cast(array() as array<struct<k:int,block:bigint,slot:bigint>>)),
  (s, c) -> transform(array(aggregate(
    sequence(1L, least({CHUNK}L, blocks - c * {CHUNK})),
    named_struct('t', s.t, 'done', s.done, 'part', cast(array() as array<struct<k:int,block:bigint,slot:bigint>>)),
    (x, n) -> transform(
      array(transform(
        filter(sequence(0, size(shares) - 1), i -> x.done[i] < shares[i].b),
        i -> named_struct(
          'release', if(shares[i].u > 0, (x.done[i] * total) div shares[i].u, NULL),
          'deadline', if(shares[i].u > 0, ((x.done[i] + 1) * total + shares[i].u - 1) div shares[i].u, 9223372036854775807L),
          'k', i)
      )),
      open -> transform(
        array(greatest(x.t, array_min(transform(open, o -> o.release)))),
        t -> transform(
          array(array_min(transform(
            filter(open, o -> coalesce(o.release <= t, forall(open, q -> q.release IS NULL))),
            o -> named_struct('deadline', o.deadline, 'k', o.k)))),
          pick -> named_struct(
            't', t + 1,
            'done', transform(x.done, (d, i) -> d + if(i = pick.k, 1L, 0L)),
            'part', concat(x.part, array(named_struct('k', pick.k, 'block', x.done[pick.k] + 1, 'slot', t))))
        )[0]
      )[0]
    )[0]
  )), y -> named_struct('t', y.t, 'done', y.done, 'plan', concat(s.plan, y.part)))[0]
).plan
"""


def schedule(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """source, u, total, block (from 1), release, deadline, slot, before of every block.

    ``before`` counts the documents of all blocks that ran earlier. Blocks outside the mixture
    have the slot they follow in as release, and null as deadline.
    """
    one = shares(docs, source, weights, block_docs).where("size(shares) > 0")
    add = lambda field: F.aggregate("shares", F.lit(0).cast("long"), lambda s, x: s + x[field])
    one = one.withColumn("total", add("u")).withColumn("blocks", add("b"))
    ran = one.select("shares", "total", F.explode(F.expr(_SCHEDULE)).alias("ran"))
    at = F.col("shares")[F.col("ran.k")]
    size = F.least(F.lit(block_docs), at["n"] - (F.col("ran.block") - 1) * block_docs)
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    flat = ran.select(at["source"].alias("source"), at["u"].alias("u"), "total", F.col("ran.block").alias("block"), F.col("ran.slot").alias("slot"), size.alias("size"))
    flat = flat.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    return flat.selectExpr("source", "u", "total", "block", "if(u > 0, ((block - 1) * total) div u, slot) AS release", "if(u > 0, (block * total + u - 1) div u, NULL) AS deadline", "slot", "before")


def placed(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, block_docs: int | None = None) -> DataFrame:
    """doc, each row as one struct (so that no name can clash), with block, release, deadline, slot, mix_order."""
    block_docs = block_docs or block_size(docs.count())
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    dealt = docs.select(whole.alias("doc"), F.col("doc_id").alias("id"), _source(source).alias("source"), key.alias("key"), F.substring(key, 1, 3).alias("bucket"))
    counts = docs.select(_source(source).alias("source"), F.substring(key, 1, 3).alias("bucket")).groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "id")
    numbered = dealt.withColumn("row", (F.row_number().over(within) - 1).cast("long")).join(counts, ["source", "bucket"]).select("doc", "source", (F.col("before") + F.col("row")).alias("rank"))
    numbered = numbered.withColumn("block", F.expr(f"rank div {block_docs} + 1"))

    few = docs.select(_source(source).alias("s")).distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda x: x)
    slots = schedule(docs, source, weights, block_docs).select("source", "block", "release", "deadline", "slot", F.col("before").alias("start"))
    joined = numbered.join(hint(slots), ["source", "block"])
    return joined.selectExpr("doc", "block - 1 AS block", "release", "deadline", "slot", f"start + rank % {block_docs} AS mix_order")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with __block, __release, __deadline, __slot and __mix_order of each row.

    Blocks and slots count from 0; __mix_order is each row's place in the mixture, without gaps.
    """
    return placed(docs, **options).select("doc.*", *[F.col(c).alias(f"__{c}") for c in ("block", "release", "deadline", "slot", "mix_order")])


def in_mix_order(docs: DataFrame, **options) -> DataFrame:
    """``docs``, same columns and rows, written order following the mixture."""
    return placed(docs, **options).select("doc", "mix_order").repartitionByRange("mix_order").sortWithinPartitions("mix_order").select("doc.*")


#: DuckDB SQL for ``mix`` over ``documents`` with the default parameters.
ORACLE = f"""
WITH RECURSIVE size AS (
  SELECT greatest({BLOCK_DOCS}, CAST(ceil(count(*) / {MOST_BLOCKS}) AS BIGINT)) AS docs FROM documents
), sizes AS (
  SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY ALL
), shares AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY source) AS k, source, n AS rows, CAST(floor(sqrt(n) * 1000) AS BIGINT) AS u, CAST((n + size.docs - 1) // size.docs AS BIGINT) AS b FROM sizes, size
), lists AS MATERIALIZED (
  SELECT list(u ORDER BY k) AS us, list(b ORDER BY k) AS bs, CAST(sum(u) AS BIGINT) AS total, CAST(sum(b) AS BIGINT) AS blocks FROM shares
), steps AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS block, list_transform(us, lambda x: CAST(0 AS BIGINT)) AS done FROM lists
  UNION ALL
  SELECT n + 1, t, pick.k, done[pick.k] + 1, list_transform(done, lambda d, i: d + CASE WHEN i = pick.k THEN 1 ELSE 0 END)
  FROM (
    SELECT n, t, done, list_min(list_transform(list_filter(open, lambda o: o.release <= t), lambda o: {{'deadline': o.deadline, 'k': o.k}})) AS pick
    FROM (
      SELECT n, done, open, greatest(slot + 1, list_min(list_transform(open, lambda o: o.release))) AS t
      FROM (
        SELECT n, slot, done, list_transform(list_filter(range(1, len(us) + 1), lambda i: done[i] < bs[i]),
          lambda i: {{'release': (done[i] * total) // us[i], 'deadline': ((done[i] + 1) * total + us[i] - 1) // us[i], 'k': i}}) AS open
        FROM steps, lists WHERE n < blocks
      )
    )
  )
), slots AS MATERIALIZED (
  SELECT source, u, total, block, slot, coalesce(sum(least(size.docs, rows - (block - 1) * size.docs)) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM steps JOIN shares USING (k), lists, size WHERE steps.n > 0
), ranked AS (
  SELECT doc_id, source, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r FROM documents
)
SELECT doc_id, ranked.source AS source, block - 1 AS block, ((block - 1) * total) // u AS release, (block * total + u - 1) // u AS deadline, slot, CAST(before + r % docs AS BIGINT) AS mix_order
FROM ranked, size JOIN slots ON slots.source = ranked.s AND slots.block = r // docs + 1
"""
