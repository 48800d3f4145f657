"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

Method
------
1. Each whole text becomes its set of 5-word shingle hashes. Equal word sequences are one node
   of the graph, whatever their ids, so copies are never paired.
2. 128 MinHash samples give 32 bands of 4. A pair at Jaccard 0.75 shares no band with
   probability (1 - 0.75^4)^32 = 5e-6.
3. The samples are folded into a 512-bit parity bitmap (odd sketch). The population count z
   of two bitmaps' XOR gives 1 + 512/(4*128) * ln(1 - 2z/512) as the similarity estimate;
   a candidate below ``SKETCH_FLOOR`` (five standard errors under the threshold) is dropped.
4. Star pass: each bucket's members are compared with its smallest node only, so a hot bucket
   costs one row per member. Links are confirmed on the full sets; a centre with more than
   ``HOT_ROWS`` partners is confirmed in as many parts.
5. Residual pass: a bucket's pairs with its centre are settled, so only buckets whose other
   members are of several groups stay open, and of buckets with the same such members the one
   of the first band. Each is handled whole by one task, tile by tile of ``TILE`` rows; only one of
   more than ``BLOCK`` rows or ``BLOCK_SHINGLES`` shingles is cut into blocks, dealt as block pairs.
   Tiles compare sketches across groups, then intersect full sets as a matrix product. Only
   links that join two groups of a task leave it.
6. Components are labelled by alternating large-star and small-star steps, all distributed.

Nulls and texts without words have an empty set and stay alone. Rows whose ``doc_id`` is null
keep null component and are never linked. Extra columns are ignored. An empty table gives an
empty result. Rows that repeat a doc_id are rows of their own, each with the component of its
text, whose label is the smallest doc_id of any row in it. A very long text costs time and
memory in proportion to its words, in the one task that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievetext.llm.arrow_tools import grouped, list_column, list_rows
from sievetext.llm.shingles import U64, WordHashes, mix, shingle_hashes, words_of
from sievetext.session import cut_lineage

SAMPLES, BANDS, SKETCH_BITS = 128, 32, 512
SKETCH_FLOOR = 0.56
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20
#: Rows of either side that are compared at once.
TILE = 512
#: Rows of one key that a join handles in one part.
HOT_ROWS = 4096
#: Ids (8 bytes each) that are sent to every executor; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_RNG = np.random.default_rng(20_240_501)
_A = _RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)


def min_samples(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the 128 hash functions over a set of 64-bit hashes."""
    x = (shingles >> U64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(best, (_A[:, None] * x[None, k : k + 4096] + _B[:, None]).min(1), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a matrix of samples (documents x SAMPLES)."""
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U64)), (len(samples), BANDS)).copy()
    by_band = samples.reshape(len(samples), BANDS, -1)
    for k in range(by_band.shape[2]):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + by_band[:, :, k].astype(U64))
    return keys.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as documents x (SKETCH_BITS / 64) words."""
    place = mix(samples.astype(U64) + (np.arange(SAMPLES, dtype=U64) << U64(33))[None, :])
    place = (place % U64(SKETCH_BITS)).astype(np.int64)
    parity = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    rows = np.repeat(np.arange(len(samples)), SAMPLES)
    np.add.at(parity, (rows, place.ravel()), 1)
    return np.packbits(parity & 1, axis=1, bitorder="little").view(np.int64)


def sketch_similarity(different_bits: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the population count of two sketches' XOR."""
    share = np.minimum(2.0 * different_bits / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log1p(-share)


#: Most differing bits with which a pair still reaches SKETCH_FLOOR.
MOST_BITS = int(np.flatnonzero(sketch_similarity(np.arange(SKETCH_BITS // 2)) >= SKETCH_FLOOR)[-1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            samples, sizes, keys = [], [], []
            for text in part["text"]:
                words = words_of(text.as_py())
                shingles = shingle_hashes(hashes.of(words))
                sizes.append(len(shingles))
                keys.append(words_key(words))
                samples.append(min_samples(shingles))
            samples = np.array(samples)
            bands, sketches = band_keys(samples), odd_sketches(samples)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["text_key"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), list_column(list(bands), pa.int64()), list_column(list(sketches), pa.int64())],
                ["doc_id", "text_key", "n_shingles", "words_key", "bands", "sketch"],
            )


def words_key(words: list[bytes]) -> bytes:
    """128 bits that stand for a word sequence."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def text_key(text: F.Column) -> F.Column:
    """128 bits that stand for a text as it is; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def features(docs: DataFrame) -> DataFrame:
    """Keys of the text and of its words, n_shingles, band keys and odd sketch of each row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key(F.col("text")).alias("text_key")).mapInArrow(
        _features, "doc_id long, text_key binary, n_shingles long, words_key binary, bands array<long>, sketch array<long>"
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            words = [words_of(t.as_py()) for t in part["text"]]
            sets = [shingle_hashes(hashes.of(w)).view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([words_key(w) for w in words], pa.binary()), list_column(sets, pa.int64())], ["words_key", "shingles"])


def shingle_sets(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the nodes whose ids are listed, from their whole texts."""
    wanted = cut_lineage(nodes.join(ids, "id", "left_semi").select("id", "rep", "words_key"))
    hint = F.broadcast if wanted.count() <= BROADCAST_IDS else (lambda x: x)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(hint(wanted.select("rep").distinct()), F.col("doc_id") == F.col("rep"), "left_semi")
    sets = texts.mapInArrow(_sets, "words_key binary, shingles array<long>").dropDuplicates(["words_key"])
    return cut_lineage(sets.join(wanted.select("id", "words_key"), "words_key").select("id", "shingles"))


def join_split(many: DataFrame, few: DataFrame, key: str, by: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` joined to ``few``, which has a row a key; keys in ``hot`` (key, rows) are split by column ``by``."""
    hot = cut_lineage(hot.where(F.col("rows") > HOT_ROWS).select(key, F.ceil(F.col("rows") / HOT_ROWS).cast("int").alias("__parts")))
    hint = F.broadcast if hot.count() <= BROADCAST_IDS else (lambda x: x)
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")).cast("int"), F.lit(0))
    left = many.join(hint(hot), key, "left").withColumn("__part", part).drop("__parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    right = few.join(hint(hot), key, "left").withColumn("__part", every).drop("__parts")
    return left.join(right, [key, "__part"], how).drop("__part")


def _bits_apart(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets have 100 * |A and B| >= percent * |A or B|."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("a_set"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("b_set"))
    both = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    union = F.size("a_set") + F.size("b_set") - both
    hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("rows"))
    return join_split(pairs.join(right, "b"), left, "a", "b", hot).where(100 * both >= percent * union).select("a", "b")


def _shared_earlier(mine: np.ndarray, theirs: np.ndarray, key: int) -> np.ndarray:
    """For each pair: whether a band before the one with this key is equal as well."""
    earlier = np.zeros((len(mine), len(theirs)), bool)
    done = np.zeros(len(mine), bool)
    for k in range(BANDS):
        done |= mine[:, k] == key
        earlier |= (mine[:, k][:, None] == theirs[:, k][None, :]) & ~done[:, None]
    return earlier


def _rows(table: pa.Table, name: str) -> np.ndarray:
    return list_rows(table[name])[1].reshape(table.num_rows, -1)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks of a block pair; twice all rows if it is one block."""
    every = np.arange(table.num_rows)
    if table["i"][0] == table["j"][0]:
        return every, every
    side = table["side"].to_numpy()
    return every[side == 0], every[side == 1]


def _wanted(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tile by tile, both sides' rows, and their pairs that cross groups, meet here first and pass the sketch."""
    every, others = _sides(table)
    sketch, bands, group = _rows(table, "sketch").view(U64), _rows(table, "bands"), table["label"].to_numpy()
    key = table["bkey"][0].as_py()
    for begin in range(0, len(every), TILE):
        left = every[begin : begin + TILE]
        for other in range(begin if others is every else 0, len(others), TILE):
            right = others[other : other + TILE]
            want = group[left][:, None] != group[right][None, :]
            if others is every and other == begin:
                want = np.triu(want, 1)
            if not want.any():
                continue
            apart = np.zeros(want.shape, np.uint16)
            for k in range(sketch.shape[1]):
                apart += np.bitwise_count(sketch[left, k][:, None] ^ sketch[right, k][None, :])
            want &= apart <= MOST_BITS
            if want.any():
                want &= ~_shared_earlier(bands[left], bands[right], key)
            if want.any():
                yield left, right, want


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of block pairs that have a pair to confirm there."""
    for table in grouped(batches, ["bkey", "i", "j"]):
        keep = np.zeros(table.num_rows, bool)
        for left, right, want in _wanted(table):
            keep[left[want.any(1)]] = True
            keep[right[want.any(0)]] = True
        if keep.any():
            kept = table.filter(pa.array(keep))
            yield from kept.combine_chunks().to_batches()


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of sets of two blocks, as a product of incidence matrices."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    total = np.zeros((len(left), len(right)), np.int32)
    for begin in range(0, len(shared), 2048):
        columns = shared[begin : begin + 2048]
        sides = []
        for sets in (left, right):
            matrix = np.zeros((len(sets), len(columns)), np.float32)
            for row, values in enumerate(sets):  # sets and columns are sorted
                part = values[np.searchsorted(values, columns[0]) : np.searchsorted(values, columns[-1], "right")]
                at = np.searchsorted(columns, part)
                matrix[row, at[columns[at] == part]] = 1
            sides.append(matrix)
        total += (sides[0] @ sides[1].T).astype(np.int32)
    return total


def _confirm_blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["bkey", "i", "j"]):
            ids, label = table["id"].to_numpy(), table["label"].to_numpy()
            offsets, flat = list_rows(table["shingles"])
            sets = [np.sort(flat[a:b]) for a, b in zip(offsets, offsets[1:])]
            size = np.diff(offsets)
            group = {x: x for x in label.tolist()}

            def find(x: int) -> int:
                while group[x] != x:
                    group[x] = x = group[group[x]]
                return x

            out = []
            for left, right, want in _wanted(table):
                left, right, want = left[want.any(1)], right[want.any(0)], want[want.any(1)][:, want.any(0)]
                both = intersections([sets[k] for k in left], [sets[k] for k in right])
                linked = want & (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both))
                for a, b in zip(*np.nonzero(linked)):
                    a, b = left[a], right[b]
                    p, q = find(int(label[a])), find(int(label[b]))
                    if p != q:
                        group[max(p, q)] = min(p, q)
                        out.append((int(ids[a]), int(ids[b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over the undirected links (a, b).

    Alternating large-star and small-star steps; each halves the depth of the trees, and an
    aggregate takes each node's smallest neighbour, so hubs are combined before the shuffle.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut_lineage(
            large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _links(docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect the nodes of each group."""
    keys = nodes.select("id", "n_shingles", F.posexplode("bands").alias("band", "bkey"))
    shared = keys.groupBy("bkey").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    members = cut_lineage(keys.join(shared, "bkey"))

    sketches = nodes.select("id", "sketch")
    star = members.where("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    star = star.join(sketches.toDF("a", "a_sketch"), "a").join(sketches.toDF("b", "b_sketch"), "b").where(_bits_apart("a_sketch", "b_sketch") <= MOST_BITS)
    star = cut_lineage(star.select("a", "b"))
    ids = star.select(F.col("a").alias("id")).unionByName(star.select(F.col("b").alias("id"))).distinct()
    star_links = cut_lineage(confirm(star, shingle_sets(docs, nodes, ids), percent))

    near = star_links.groupBy("b").agg(F.min("a").alias("up"))
    far = near.select(F.col("b").alias("up"), F.col("up").alias("top"))
    label = near.join(far, "up", "left").select(F.col("b").alias("id"), F.coalesce("top", "up").alias("near"))
    labelled = members.where("id != centre").join(label, "id", "left").select("bkey", "band", "id", "n_shingles", F.coalesce("near", "id").alias("label"))
    labelled = cut_lineage(labelled)
    alike = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"alike{k}") for k in range(2)]
    open_keys = labelled.groupBy("bkey", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("weight"), *alike).where("lo != hi")
    # a pair that meets in a bucket left out here meets in the one of an earlier band, or was compared with its centre
    open_keys = open_keys.groupBy("members", "weight", "alike0", "alike1").agg(F.min_by("bkey", "band").alias("bkey"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    rest = labelled.join(open_keys.select("bkey", blocks.alias("blocks")), "bkey").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("bkey", "id", "label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    rest = rest.join(nodes.select("id", "bands", "sketch"), "id").repartition("bkey", "i", "j").sortWithinPartitions("bkey", "i", "j", "id")
    row = "id long, bkey long, label long, i int, j int, side int, bands array<long>, sketch array<long>"
    rest = rest.select("id", "bkey", "label", "i", "j", "side", "bands", "sketch").mapInArrow(_screen, row)
    rest = cut_lineage(rest)
    sets = shingle_sets(docs, nodes, rest.select("id").distinct())
    rest = rest.join(sets, "id").repartition("bkey", "i", "j").sortWithinPartitions("bkey", "i", "j", "id")
    return star_links.unionByName(rest.mapInArrow(_confirm_blocks(percent), "a long, b long"))


def grouped_rows(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, text_key, n_shingles, group and component_id (its smallest doc_id) of every row.

    ``group`` is null for rows without words or id.
    """
    found = cut_lineage(features(docs))
    sized = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    alike = sized.groupBy("words_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")])
    # nullable, as links from Python are: checkpoints of a union of both kinds can't be joined to themselves
    nodes = cut_lineage(alike.withColumn("id", F.nullif(F.monotonically_increasing_id(), F.lit(-1))))
    component = components(_links(docs, nodes, percent))
    component = component.unionByName(component.select(F.col("component").alias("id"), "component").distinct())
    joined = nodes.select("id", "rep").join(component, "id")
    least = joined.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("rows"))
    tops = join_split(component, least.select("component", "least"), "component", "id", least.select("component", "rows"))
    whole = nodes.select("id", "rep", "words_key").join(tops, "id", "left")
    whole = cut_lineage(whole.select("words_key", F.coalesce("component", "id").alias("group"), F.coalesce("least", "rep").alias("found")))
    usable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    rows = found.select("doc_id", "text_key", "n_shingles", "words_key", F.coalesce("doc_id", F.xxhash64("text_key")).alias("__by"))
    merged = join_split(rows, whole, "words_key", "__by", nodes.select("words_key", "rows"), "left")
    return merged.select("doc_id", "text_key", "n_shingles", F.when(usable, F.col("group")).alias("group"), F.when(usable, F.col("found")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``(doc_id, text)."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return grouped_rows(docs, percent).select("doc_id", "n_shingles", "component_id", kept)


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: of the smallest doc_id, then text key.

    Rows without words or without an id all stay; of rows alike in id and text one stays.
    """
    rows = cut_lineage(grouped_rows(docs, percent).where("group IS NOT NULL").groupBy("group", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies")))
    first = rows.groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("rows"))
    several = cut_lineage(first.where("rows > 1"))
    gone = join_split(rows, several.select("group", "first"), "group", "text_key", several.select("group", "rows")).where(F.struct("doc_id", "text_key") != F.col("first"))
    gone = cut_lineage(gone.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")))
    twice = cut_lineage(rows.where("copies > 1").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("key"))
    hint = F.broadcast if gone.count() <= BROADCAST_IDS else (lambda x: x)
    rest = whole.join(hint(gone), ["id", "key"], "left_anti")
    if repeated := twice.count():
        hint = F.broadcast if repeated <= BROADCAST_IDS else (lambda x: x)
        more = rest.join(hint(twice), ["id", "key"], "left_semi").groupBy("id", "key").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
        rest = rest.join(hint(twice), ["id", "key"], "left_anti").select("doc").unionByName(more.select("doc"))
    return rest.select("doc.*")
