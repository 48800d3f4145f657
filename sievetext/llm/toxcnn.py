"""Toxicity of whole texts: a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first four and five
characters. Filters of widths 1, 2 and 3 run over the words; each filter's largest response
over the whole text feeds a logistic layer. Only texts are inputs of a score.

Thresholds are calibrated by language: the language is guessed from the text's function
words, and for each language the logit is shifted so that 0.5 is the cut that makes the
fewest mistakes on labelled rows kept out of the fit.

The model is fitted on every labelled document except held-out ones (crc32 of the id as text
divisible by 5). Documents are dealt to shards of about ``SHARD_ROWS`` by the hash of their ids. In each
epoch every shard starts from the common model and moments and goes once through its documents; then
the changes of both are averaged, those of an embedding over the shards that changed it. One document in five
sets the thresholds instead, which are counted over all of these. The driver holds the model and
sums only. A caller may ask for a bounded sample instead (``sample_rows``): the labelled rows whose
ids hash lowest, and of these the first that have at most ``SAMPLE_CHARS`` characters together.

If an id has several labels the smallest counts. Null text counts as empty; a text without words scores by the bias alone, so it is clean
unless empty texts are labelled toxic. Labels that are null are not used. Repeated rows are
each returned, equal texts get equal scores. Without any usable label every score is 0.
A score reads every word of the text, some thousand at a time; a very long text costs its words'
memory in the one task that holds it. Extra columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievetext.llm.arrow_tools import map_kept
from sievetext.llm.sampling import hashed_share
from sievetext.session import cut_lineage

SLOTS, DIM, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 16
WORD = re.compile(r"\w+")
HELD_OUT = 5
SAMPLE_CHARS = 48_000_000
#: Documents of a shard of the fit, passes over them, documents of a step.
SHARD_ROWS, EPOCHS, STEP_ROWS = 8000, 8, 64
#: Rows of the embedding table that travel together, and the label ids that are sent to every
#: executor; more are joined by a shuffle.
BLOCK_SLOTS, BROADCAST_LABELS = 1 << 10, 1_000_000
#: Logits are counted in steps of 1 / FINE where thresholds are set.
FINE = 1024
#: Words whose vectors a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 300_000
#: Words of a text that are convolved at a time; products this small stay on one BLAS thread.
CHUNK = 1 << 10

#: Fixed function words by language.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine mit von zu auf für im den sich auch als dem es",
    "en": "the of and to in is that for it was on with as be by this from at are not",
    "es": "el la los las que de y en un una con por para no se su al es como más",
    "fr": "le la les des que et en un une du qui dans pour par pas sur est avec au de",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_VOTES = {w: [k for k, words in enumerate(FUNCTION_WORDS.values()) if w in words.split()] for words in FUNCTION_WORDS.values() for w in words.split()}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def language_of(words: list[str]) -> int:
    """Position in LANGUAGES of the language whose function words are most frequent."""
    votes = [0.0] * len(FUNCTION_WORDS)
    for w in words:
        for k in _VOTES.get(w, ()):
            votes[k] += 1 / len(_VOTES[w])
    best = max(range(len(votes)), key=votes.__getitem__)
    return best if votes[best] > 0 else len(votes)


def slots_of(word: str) -> tuple[int, int, int]:
    """Embedding rows of a word and of its prefixes."""
    h = lambda tag, w: zlib.crc32(f"{tag}{w}".encode("utf-8", "surrogatepass")) % SLOTS
    return h("w", word), h("4", word[:4]), h("5", word[:5])


class Words(dict):
    """word -> row in ``slots``."""

    def __init__(self) -> None:
        super().__init__()
        self.slots = np.empty((1 << 12, 3), np.int32)

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.slots):
            self.slots = np.concatenate([self.slots, np.empty_like(self.slots)])
        self.slots[row] = slots_of(word)
        self[word] = row
        return row

    def rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass
class ToxicityCnn:
    embed: np.ndarray
    filters: list[np.ndarray]
    shift: list[np.ndarray]
    out: np.ndarray
    bias: float
    #: Logit of each language's threshold.
    cut: np.ndarray

    def pooled(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response and the word where it is; texts are padded by zeros."""
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        where = np.zeros(len(best), np.int64)
        for begin in range(0, len(vectors), CHUNK):
            part = vectors[begin : begin + CHUNK + max(WIDTHS) - 1]
            count = min(CHUNK, len(vectors) - begin)
            padded = np.zeros((count + max(WIDTHS) - 1, DIM), np.float32)
            padded[: len(part)] = part
            for k, width in enumerate(WIDTHS):
                response = padded[:count] @ self.filters[k][:DIM]
                for j in range(1, width):
                    response += padded[j : count + j] @ self.filters[k][j * DIM : (j + 1) * DIM]
                at = response.argmax(0)
                top = response[at, np.arange(FILTERS)]
                place = slice(k * FILTERS, (k + 1) * FILTERS)
                better = top > best[place]
                best[place] = np.where(better, top, best[place])
                where[place] = np.where(better, at + begin, where[place])
        return np.maximum(best + np.concatenate(self.shift), 0), where

    def logit(self, vectors: np.ndarray) -> float:
        if not len(vectors):
            return float(self.bias)
        return float(self.pooled(vectors)[0] @ self.out + self.bias)

    def scores(self, texts: list[str | None], cache: Words, table: list) -> np.ndarray:
        """Probabilities; ``table`` holds the cached words' vectors between calls."""
        out = np.empty(len(texts))
        if len(cache) > CACHE_WORDS:
            cache.clear()
            table[0] = np.empty((0, DIM), np.float32)
        for k, text in enumerate(texts):
            words = words_of(text)
            rows = cache.rows(words)
            if len(cache) > len(table[0]):
                room = np.empty((len(cache.slots), DIM), np.float32) if len(table) < 2 or len(table[1]) < len(cache) else table[1]
                room[: len(table[0])] = table[0]
                room[len(table[0]) : len(cache)] = self.embed[cache.slots[len(table[0]) : len(cache)]].sum(1)
                table[:] = [room[: len(cache)], room]
            z = self.logit(table[0][rows]) - self.cut[language_of(words)]
            out[k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def untrained(seed: int = 7) -> ToxicityCnn:
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.3, (SLOTS, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    return ToxicityCnn(embed, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), -2.0, np.zeros(len(LANGUAGES)))


def constant(toxic: bool) -> ToxicityCnn:
    """A model that gives every text the same score."""
    model = untrained()
    model.out[:] = 0
    model.bias = 30.0 if toxic else -30.0
    return model


def toxic_weight(share: float) -> float:
    """Weight of a toxic text in the loss, given their share."""
    return min(4.0, (1 - share) / share)


def rate_of(epoch: int, epochs: int) -> float:
    return 0.02 * (1 - epoch / epochs) + 0.002


class Fit:
    """Adam on the weighted log loss, a batch of texts at a time; changes ``model`` and its moments."""

    def __init__(self, model: ToxicityCnn, state: dict | None = None) -> None:
        self.model = model
        self.bias = np.array([model.bias], np.float32)
        self.state = state or {name: (np.zeros_like(x), np.zeros_like(x)) for name, x in self.weights().items()}

    def weights(self) -> dict[str, np.ndarray]:
        model = self.model
        parts = {f"{tag}{k}": x for tag, some in (("f", model.filters), ("s", model.shift)) for k, x in enumerate(some)}
        return {"e": model.embed, **parts, "o": model.out, "b": self.bias}

    def copy(self) -> "Fit":
        old = self.model
        model = replace(old, embed=old.embed.copy(), filters=[f.copy() for f in old.filters], shift=[x.copy() for x in old.shift], out=old.out.copy())
        return Fit(model, {name: (m.copy(), v.copy()) for name, (m, v) in self.state.items()})

    def blocks(self) -> list[np.ndarray]:
        """Weights and moments: parts of the embedding table, a row for each slot, then all others."""
        embed = np.hstack([self.model.embed, *self.state["e"]])
        rest = [y.ravel() for name, x in self.weights().items() if name != "e" for y in (x, *self.state[name])]
        return [*np.split(embed, SLOTS // BLOCK_SLOTS), np.concatenate(rest)]

    def apply(self, block: int, moved: np.ndarray) -> None:
        """Add a block's mean change."""
        if block < SLOTS // BLOCK_SLOTS:
            at = slice(block * BLOCK_SLOTS, (block + 1) * BLOCK_SLOTS)
            for part, change in zip((self.model.embed, *self.state["e"]), np.split(moved.reshape(BLOCK_SLOTS, -1), 3, 1)):
                part[at] += change
            np.maximum(self.state["e"][1], 0, out=self.state["e"][1])
            return
        for name, x in self.weights().items():
            if name != "e":
                for part in (x, *self.state[name]):
                    part += moved[: part.size].reshape(part.shape)
                    moved = moved[part.size :]
                np.maximum(self.state[name][1], 0, out=self.state[name][1])
        self.model.bias = float(self.bias[0])

    def _adam(self, name, value, slope, rate, rows=None):
        m, v = self.state[name]
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * slope
        v[at] = 0.99 * v[at] + 0.01 * slope**2
        value[at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-6)

    def step(self, slots: list[np.ndarray], label: list[float], toxic: float, rate: float) -> None:
        """One step over the texts with these embedding rows; toxic ones weigh ``toxic``."""
        model, deep = self.model, len(WIDTHS) * FILTERS
        g_filters = [np.zeros_like(f) for f in model.filters]
        g_shift = np.zeros(deep, np.float32)
        g_out = np.zeros(deep, np.float32)
        g_bias = 0.0
        rows, slopes = [], []
        for words, y in zip(slots, label):
            if not len(words):
                continue
            vectors = model.embed[words].sum(1)
            pool, where = model.pooled(vectors)
            z = float(pool @ model.out + self.bias[0])
            gap = np.float32((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * (toxic if y == 1 else 1.0) / len(slots))
            g_out += gap * pool
            g_bias += gap
            back = gap * model.out * (pool > 0)
            g_shift += back
            for k, width in enumerate(WIDTHS):
                place = slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(width):
                    at = where[place] + j
                    inside = at < len(vectors)
                    seen = np.where(inside[:, None], vectors[np.minimum(at, len(vectors) - 1)], 0)
                    part = slice(j * DIM, (j + 1) * DIM)
                    g_filters[k][part] += seen.T * back[place]
                    rows.append(words[at[inside]])
                    slopes.append((model.filters[k][part] * back[place]).T[inside])
        for k in range(len(WIDTHS)):
            self._adam(f"f{k}", model.filters[k], g_filters[k] + 1e-5 * model.filters[k], rate)
            self._adam(f"s{k}", model.shift[k], g_shift[k * FILTERS : (k + 1) * FILTERS], rate)
        self._adam("o", model.out, g_out + 1e-4 * model.out, rate)
        self._adam("b", self.bias, np.array([g_bias], np.float32), rate)
        if rows:
            hit = np.concatenate(rows)
            slope = np.repeat(np.concatenate(slopes), 3, 0)
            used, at = np.unique(hit.ravel(), return_inverse=True)
            total = np.zeros((len(used), DIM), np.float32)
            np.add.at(total, at, slope)
            self._adam("e", model.embed, total, rate, used)
        model.bias = float(self.bias[0])


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 7) -> ToxicityCnn:
    """Fit in this process; one text in five sets the thresholds and isn't fitted."""
    rng = np.random.default_rng(seed)
    label = np.array(toxic, np.float64)
    if len(texts) == 0 or label.min(initial=1) == label.max(initial=0):
        return constant(len(texts) > 0 and bool(label[0]))
    model, cache = untrained(seed), Words()
    language, rows_of = np.zeros(len(texts), np.int64), []
    for k, text in enumerate(texts):  # one text's words at a time: as strings they are large
        words = words_of(text)
        language[k] = language_of(words)
        rows_of.append(cache.rows(words).astype(np.int32))
    slots = [cache.slots[r] for r in rows_of]
    kept_out = np.arange(len(texts)) % 5 == 4
    fit = Fit(model)
    for epoch in range(epochs):
        order = rng.permutation(np.flatnonzero(~kept_out))
        for begin in range(0, len(order), STEP_ROWS):
            batch = order[begin : begin + STEP_ROWS]
            fit.step([slots[d] for d in batch], label[batch], toxic_weight(label.mean()), rate_of(epoch, epochs))
    check = np.flatnonzero(kept_out)
    logits = np.array([model.logit(model.embed[slots[d]].sum(1)) for d in check])
    overall = best_cut(logits, label[check])
    for k in range(len(LANGUAGES)):
        mine = language[check] == k
        model.cut[k] = best_cut(logits[mine], label[check][mine]) if label[check][mine].sum() >= 5 else overall
    return model


def best_cut(logits: np.ndarray, label: np.ndarray) -> float:
    """The middle of the widest gap between logits among cuts with the fewest mistakes."""
    order = np.argsort(logits)
    return counted_cut(logits[order], label[order], 1 - label[order])


def counted_cut(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """``best_cut`` of rising logits with so many toxic and clean texts each."""
    if not toxic.sum() or not clean.sum():
        return 0.0
    wrong = np.r_[0, np.cumsum(toxic)] + np.r_[np.cumsum(clean[::-1])[::-1], 0]
    edge = np.r_[z[0] - 1, z, z[-1] + 1]
    best = np.flatnonzero(wrong == wrong.min())
    k = best[np.argmax(edge[best + 1] - edge[best])]
    return float((edge[k] + edge[k + 1]) / 2)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Guessed language and embedding rows of each text."""
    cache = Words()
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            language, slots = [], []
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for text in part["text"]:
                words = words_of(text.as_py())
                language.append(language_of(words))
                rows = cache.rows(words)  # may replace the table
                slots.append(cache.slots[rows].astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([part["h"], part["toxic"], pa.array(language, pa.int32()), pa.array(slots, pa.binary())], ["h", "toxic", "language", "slots"])


def _texts(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """The columns' values and the embedding rows, a text at a time."""
    for batch in batches:
        for *row, slots in zip(*[batch[c].to_pylist() for c in columns], batch["slots"]):
            yield *row, np.frombuffer(slots.as_buffer(), np.uint16).reshape(-1, 3).astype(np.int32)


def _changes(shard: int, rows: int, old: Fit, new: Fit) -> pa.RecordBatch:
    """What a shard changed, by block."""
    moved = [(x - y).tobytes() for x, y in zip(new.blocks(), old.blocks())]
    ints = [pa.array(range(len(moved)), pa.int32()), pa.array([shard] * len(moved), pa.int64()), pa.array([rows] * len(moved), pa.int64())]
    return pa.RecordBatch.from_arrays([*ints, pa.array(moved, pa.binary())], ["block", "shard", "rows", "moved"])


def _epoch(shared, toxic: float, rate: float):
    """One pass of every shard, from the common model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, last, fit = shared.value, None, None
        rows, slots, label = 0, [], []

        def step():
            if slots:
                fit.step(slots, label, toxic, rate)
                slots.clear(), label.clear()

        for shard, y, words in _texts(batches, ["shard", "toxic"]):
            if shard != last:
                if fit:
                    step()
                    yield _changes(last, rows, old, fit)
                last, rows = shard, 0
                fit = old.copy()
            slots.append(words)
            label.append(y)
            rows += 1
            if len(slots) == STEP_ROWS:
                step()
        if fit:
            step()
            yield _changes(last, rows, old, fit)

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean change of each block by rows; of an embedding, over the shards that changed it."""
    last, total, weight = None, None, None

    def told():
        mean = (total / np.maximum(weight, 1)[:, None]).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["block", "moved"])

    for batch in batches:
        for block, rows, moved in zip(batch["block"].to_pylist(), batch["rows"].to_pylist(), batch["moved"]):
            dense = block == SLOTS // BLOCK_SLOTS
            moved = np.frombuffer(moved.as_buffer(), np.float32).reshape((1, -1) if dense else (BLOCK_SLOTS, -1))
            if block != last:
                if last is not None:
                    yield told()
                last, total, weight = block, np.zeros(moved.shape), np.zeros(len(moved))
            total += rows * moved.astype(np.float64)
            weight += rows * (dense | moved.any(1))
    if last is not None:
        yield told()


def _logits(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            z = [round(float(np.clip(model.logit(model.embed[words].sum(1)), -30, 30)) * FINE) for (words,) in _texts([batch], [])]
            yield pa.RecordBatch.from_arrays([batch["language"], pa.array(z, pa.int64()), batch["toxic"]], ["language", "z", "toxic"])

    return run


def _fit_whole(docs: DataFrame, usable: DataFrame) -> ToxicityCnn:
    """Fit on every document with a usable label (id, toxic)."""
    spark = docs.sparkSession
    usable = cut_lineage(usable.groupBy("id").agg(F.min("toxic").alias("toxic")))
    hint = F.broadcast if usable.count() <= BROADCAST_LABELS else (lambda x: x)
    h, kept_out = F.xxhash64("id").alias("h"), F.pmod(F.col("h"), F.lit(5)) == 4
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(hint(usable), F.col("doc_id") == F.col("id"))
    counted = labelled.select(h, "toxic").agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.when(~kept_out, 1))).first()
    if counted[0] == 0 or counted[1] in (0, counted[0]):
        return constant(counted[1] > 0)
    shards = max(1, -(-counted[2] // SHARD_ROWS))
    dealt = labelled.select(h, "text", "toxic").mapInArrow(_slots, "h long, toxic int, language int, slots binary")
    dealt = dealt.withColumn("shard", F.pmod(F.shiftright("h", 8), F.lit(shards)).cast("int"))
    dealt = cut_lineage(dealt.repartitionById(shards, "shard"))
    fit, toxic = Fit(untrained()), toxic_weight(counted[1] / counted[0])
    for epoch in range(EPOCHS):
        shared = spark.sparkContext.broadcast(fit)
        turn = dealt.where(~kept_out).sortWithinPartitions("shard", F.xxhash64("h", F.lit(epoch)), "h", "slots")
        moved = turn.select("shard", "toxic", "slots").mapInArrow(_epoch(shared, toxic, rate_of(epoch, EPOCHS)), "block int, shard long, rows long, moved binary")
        moved = moved.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(_averaged, "block int, moved binary").collect()
        for row in moved:
            fit.apply(row["block"], np.frombuffer(row["moved"], np.float32))
        shared.destroy()
    model = fit.model
    shared = spark.sparkContext.broadcast(model)
    logits = dealt.where(kept_out).select("language", "toxic", "slots").mapInArrow(_logits(shared), "language int, z long, toxic int")
    found = logits.groupBy("language", "z").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).collect()
    shared.destroy()
    found = np.array([tuple(r) for r in found], np.int64).reshape(-1, 4)

    def cut(rows: np.ndarray) -> float:
        z, at = np.unique(rows[:, 1], return_inverse=True)
        return counted_cut(z / FINE, np.bincount(at, rows[:, 2], len(z)), np.bincount(at, rows[:, 3], len(z)))

    for k in range(len(LANGUAGES)):
        mine = found[found[:, 0] == k]
        model.cut[k] = cut(mine if mine[:, 2].sum() >= 5 else found)
    return model


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0


def fit_on(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None) -> ToxicityCnn:
    """Fit on all labelled documents that are not held out, or on a sample of so many rows."""
    usable = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("id")))
    if sample_rows is None:
        return _fit_whole(docs, usable)
    chosen = hashed_share(usable, F.col("id"), sample_rows).orderBy(F.xxhash64("id"), "id", "toxic").limit(sample_rows).dropDuplicates(["id"])
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    first = joined.select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "toxic", F.coalesce(F.length("text"), F.lit(0)).alias("size")).orderBy("h", "doc_id", "text").limit(sample_rows)
    so_far = F.sum("size").over(Window.orderBy("h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = first.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_CHARS).orderBy("h", "doc_id", "text").select("text", "toxic").collect()
    return train([r["text"] or "" for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: ToxicityCnn, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    state: list = []

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        if not state:
            state.extend((Words(), [np.empty((0, DIM), np.float32)]))
        return [pa.array(shared.value.scores(batch.column(0).to_pylist(), *state), pa.float64())]

    return map_kept(docs, keep, [F.col(text).cast("string")], work, "score double", 512)
