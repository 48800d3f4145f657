"""Small tests of every operator: brute force, round trips, and the edge cases they define."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievetext.llm import balltree, chatformat, gif, htmlblocks, media, mixing, neardup, packing, secretscan, skipcrf, toxcnn
from sievetext.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, spans string, rank int"


def docs_of(spark, texts, sources=None):
    """Documents with columns whose names clash with those the operators use inside."""
    rows = [(k, t, "en", (sources or ["s"] * len(texts))[k], len(t or ""), "x", "y", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGE = [None, "", " \n\t", "word", "word " * 3, "x" * 50_000, "same text here for you", "same text here for you", "éı \U0001f600", "a" * 3 + " b"]


# ---- 1: near duplicates ---------------------------------------------------------------


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return [(k, len(s), find(k), find(k) == k) for k, s in enumerate(sets)]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    texts = list(EDGE)
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(99)}"
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy))
    got = neardup.near_duplicates(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_components(texts)


def test_near_duplicates_block_pairs(spark, monkeypatch):
    """A bucket of more rows than a block, with members that its centre doesn't reach."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(40):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(60)] = f"z{k}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(neardup, "BLOCK", 8)
    got = neardup.near_duplicates(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_components(texts)


def test_near_duplicates_rows_of_open_buckets(spark, monkeypatch):
    """Rows that stay open after the star pass meet in one task, not in block pairs of every bucket."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(f"z{k}" if rng.random() < 0.025 else w for w in base) for k in range(700)]
    monkeypatch.setattr(neardup, "TILE", 64, raising=False)
    rows, run = [], neardup.shingle_sets
    monkeypatch.setattr(neardup, "shingle_sets", lambda docs, nodes, ids: rows.append(nodes) or run(docs, nodes, ids))
    screened, screen = spark.sparkContext.accumulator(0), neardup._screen

    def counted(batches):
        def told():
            for batch in batches:
                screened.add(batch.num_rows)
                yield batch

        yield from screen(told())

    monkeypatch.setattr(neardup, "_screen", counted)
    got = neardup.near_duplicates(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_components(texts)
    shared = rows[0].select(F.explode("bands").alias("b")).groupBy("b").count().where("count > 2").selectExpr("sum(count - 1)").first()[0]
    assert 0 < screened.value <= shared


def test_near_duplicates_empty_and_repeated(spark):
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0
    rows = docs_of(spark, ["a b c d e f", "a b c d e f"])
    twice = rows.unionByName(rows).unionByName(rows.withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted(map(tuple, neardup.near_duplicates(twice).collect()), key=str)
    assert got == sorted([(0, 2, 0, True), (1, 2, 0, False)] * 2 + [(None, 2, None, True)] * 2, key=str)


def test_near_duplicates_of_repeated_ids(spark, monkeypatch):
    """Rows that share an id but not a text are linked each by its own text, in any row order."""
    monkeypatch.setattr(neardup, "HOT_ROWS", 2)
    words = [f"w{k}" for k in range(40)]
    near = [*words[:20], "other", *words[21:]]
    lone = " ".join(f"q{k}" for k in range(30))
    rows = [(5, lone), (5, " ".join(words)), (6, " ".join(near)), (4, lone.upper()), (9, "x"), (9, "x"), (9, "y"), (7, None), (7, "")] + [(20 + k, " ".join([*words, f"tail{k}"])) for k in range(9)]
    want = sorted([(5, 26, 4), (5, 36, 5), (6, 36, 5), (4, 26, 4), (9, 1, 9), (9, 1, 9), (9, 1, 9), (7, 0, 7), (7, 0, 7)] + [(20 + k, 37, 5) for k in range(9)])
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, f"c{i}") for i, t in order], "doc_id long, text string, `a.b` string")
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()) == want
        kept = neardup.one_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(4, lone.upper()), (5, " ".join(words)), (7, ""), (7, ""), (9, "x"), (9, "y")])


def test_components_long_chain(spark):
    links = spark.range(200).selectExpr("id + 1 AS a", "id AS b")
    assert {(r.id, r.component) for r in neardup.components(links).collect()} == {(k, 0) for k in range(1, 201)}


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, (1, neardup.SAMPLES), dtype=np.uint32)
    for differ in (0, 10, 32):
        b = a.copy()
        b[0, :differ] += np.uint32(1)
        bits = np.bitwise_count((neardup.odd_sketches(a) ^ neardup.odd_sketches(b)).view(np.uint64)).sum()
        assert abs(neardup.sketch_similarity(np.array([bits]))[0] - (1 - differ / neardup.SAMPLES)) < 0.08


# ---- 2: packing -----------------------------------------------------------------------


def test_token_ids_match_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for text in ["", "Hello there", "  two  spaces\n\n", "<|endoftext|> x", "é　\U0001f600 don't", "1" * 3000, " " * 3000, "a\x00b"]:
        assert packing.token_ids(path, text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_pack_gives_added_tokens_their_ids(spark):
    """The tokenizer at its default setting."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    end = "<|endoftext|>"
    texts = ["hello <|endoftext|> world", end, f"a  {end}  {end}{end}\n\nb", f"<{end}>", "<|endoftext|", f"é　{end}\U0001f600", f"word {end} " * 900, "no such token"]
    assert t.encode(texts[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    got = {}
    for r in packing.pack(docs_of(spark, texts), tokenizer_path()).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for k, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want = [(n, s, m, zlib.crc32(ids[s : s + m].tobytes())) for n, (s, m) in enumerate(packing.cuts(len(ids)))]
        assert sorted(got[k]) == want


def test_pack_places_every_piece(spark):
    rng = random.Random(2)
    texts = [*EDGE, *[" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([3, 40, 300, 900, 2500]))) for _ in range(60)]]
    rows = packing.pack(docs_of(spark, texts), tokenizer_path()).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, text in enumerate(texts):
        ids = packing.token_ids(tokenizer_path(), text)
        at = 0
        for n, r in enumerate(sorted(by_doc[k], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > 1024 or len(by_doc[k]) == 1)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(docs_of(spark, []), tokenizer_path()).count() == 0


def test_plan_is_near_the_bound():
    rng = random.Random(4)
    counts = {n: rng.randrange(1, 60) for n in range(1, 1025) if rng.random() < 0.9}
    packed = packing.plan(counts)
    bound = max(sum(n * c for n, c in counts.items()) / 1024, sum(c for n, c in counts.items() if n > 512))
    assert sum(b for b, _ in packed.runs()) <= 1.01 * bound + 1
    for single in ({5: 1}, {1024: 3}, {1023: 2}, {513: 7}, {}):
        held = packing.plan(single)
        assert sum(b * sum(h.values()) for b, h in held.runs()) == sum(single.values())


def test_plan_beats_best_fit_decreasing():
    """A corpus on which taking the longest first wastes a fifth of the sequences."""
    counts = {516: 600, 264: 600, 260: 600, 248: 1200}
    plain = packing.Plan(1024)
    for n in sorted(counts, reverse=True):
        if left := plain.best_fit(n, counts[n]):
            plain.fill_new({n: left})
    used = lambda p: sum(b for b, _ in p.runs())
    assert used(plain) == 1100 and used(packing.plan(counts)) == 900


def test_windows_are_packed_along_the_order(spark):
    rng = random.Random(8)
    texts = [*EDGE, *[" ".join(rng.choice(["alpha", "beta"]) for _ in range(rng.choice([3, 40, 300, 900, 2500]))) for _ in range(90)]]
    docs = docs_of(spark, texts).withColumn("a.b", F.lit(1))
    cut = packing.tokenised(docs, tokenizer_path(), ["doc_id", "a.b"])
    order = cut.select("doc_id", "pieces", (F.lit(len(texts) - 1) - F.col("doc_id")).alias("place"))
    rows = packing.pack_windows(order, "place", window=20).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.mix_order == len(texts) - 1 - r.doc_id
    assert sorted((r.doc_id, r.piece, r.length) for r in rows) == sorted((k, n, m) for k, t in enumerate(texts) for n, (_, m) in enumerate(packing.cuts(len(packing.token_ids(tokenizer_path(), t)))))
    windows = []
    for _, group in sorted(by_sequence.items()):
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and len({r.mix_order // 20 for r in group}) == 1
        windows.append(group[0].mix_order // 20)
    assert windows == sorted(windows)
    assert packing.pack_windows(order.limit(0), "place").count() == 0


# ---- 3: mixing ------------------------------------------------------------------------


def ran_within_a_block(plan, weights):
    """After every slot each source in the mixture, until used up, is within a block of its weight."""
    total = sum(weights.values())
    blocks = {s: sum(r["source"] == s for r in plan) for s in weights}
    ran = dict.fromkeys(weights, 0)
    for r in sorted(plan, key=lambda r: r["slot"]):
        for s, w in weights.items():
            if w and ran[s] < blocks[s]:
                assert abs(ran[s] - Fraction(r["slot"]) * w / total) < 1, (s, r["slot"])
        ran[r["source"]] += 1
        if weights[r["source"]]:
            assert r["release"] <= r["slot"] < r["deadline"] and r["block"] == ran[r["source"]]


def test_mixture_deviates_by_less_than_a_block(spark):
    sources = ["a"] * 400 + ["b"] * 100 + ["c"] * 9 + [None] * 3
    docs = docs_of(spark, ["t"] * len(sources), sources)
    plan = mixing.schedule(docs, block_docs=4).collect()
    assert [r["slot"] for r in plan] == sorted({r["slot"] for r in plan})
    ran_within_a_block(plan, {r["source"]: r["u"] for r in plan})
    mixed = mixing.mix(docs, block_docs=4)
    assert mixed.count() == len(sources) and mixed.select("__mix_order").distinct().count() == len(sources)
    assert mixing.mix(docs, weights={"a": 1.0, "c": 3.0}).count() == len(sources)
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_mixture_follows_exact_weights_over_the_whole_run(spark):
    """One hot source, many small ones, weights that no short cycle can hold, and none at all."""
    weights = {"hot": 0.6471, **{f"s{k}": 0.0171 + k * 0.00013 for k in range(20)}, "off": 0.0}
    sources = ["hot"] * 1500 + [f"s{k}" for k in range(20) for _ in range(40)] + ["off"] * 5 + ["unnamed"] * 5
    docs = docs_of(spark, ["t"] * len(sources), sources)
    plan = mixing.schedule(docs, weights=weights, block_docs=1).collect()
    assert len(plan) == len(sources)
    ran_within_a_block(plan, {**{s: Fraction(str(w)) for s, w in weights.items()}, "unnamed": Fraction(0)})
    last = max(r["slot"] for r in plan if r["deadline"] is not None)
    assert {r["source"] for r in plan if r["slot"] > last} == {"off", "unnamed"}
    assert mixing.whole_weights({"a": 0.1, "b": 0.35}) == {"a": 2, "b": 7}
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": -1})


def test_mixture_block_count_is_bounded():
    for rows in (0, 1, 10**5, 10**7, 10**12):
        assert rows / mixing.block_size(rows) <= mixing.MOST_BLOCKS and mixing.block_size(rows) >= mixing.BLOCK_DOCS


def test_mixture_keeps_rows_and_columns(spark):
    docs = docs_of(spark, EDGE, [f"s{k % 3}" for k in range(len(EDGE))])
    docs = docs.withColumnRenamed("spans", "a.b").withColumnRenamed("id", "__key")
    out = mixing.in_mix_order(docs.unionByName(docs))
    assert out.columns == docs.columns and out.count() == 2 * len(EDGE)
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.unionByName(docs).collect()))


# ---- 4: chat --------------------------------------------------------------------------


def test_chat_round_trip_and_mask(spark):
    rows = [(1, 0, "user", "hi <|im_end|> \x10"), (1, 1, "assistant", "</s>[INST] ok"), (1, 2, "assistant", None), (2, 0, None, ""), (None, 0, "assistant", "x" * 5000), (3, 1, "assistant", "b"), (3, 0, "system", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chatformat.verified(chatformat.format_conversations(table)).collect()}
    assert got[1].loss_chars == len("</s>[INST] ok") and got[1].n_turns == 3
    assert got[1].loss_sha256 == hashlib.sha256(b"</s>[INST] ok").hexdigest()
    assert got[3].turns_sha256 == hashlib.sha256(b"system\na\nassistant\nb\n").hexdigest()
    assert got[None].loss_chars == 5000 and got[2].n_turns == 1
    assert chatformat.verified(chatformat.format_conversations(table.limit(0))).count() == 0


def test_chat_detects_rewritten_history():
    def last_user_gets_system(turns):
        system = "".join(t for r, t in turns if r == "system")
        users = [k for k, (r, _) in enumerate(turns) if r == "user"]
        return "".join(f"<{r}>{system if users and k == users[-1] else ''}{t}</>" for k, (r, t) in enumerate(turns) if r != "system")

    text, spans = chatformat.locate(last_user_gets_system, [("system", "S"), ("user", "hi"), ("assistant", "yo"), ("user", "more")])
    assert [s["rewrites"] for s in spans] == [False, False, False, True]
    assert text[spans[2]["text_start"] : spans[2]["text_end"]] == "yo" and spans[2]["loss"]


def test_chat_marks_what_it_cannot_locate():
    turns = [("user", "hello there"), ("assistant", "a longer answer"), ("assistant", "")]
    sized = lambda turns: "".join(f"<{r} {len(t)}>{t}</>" for r, t in turns)
    text, spans = chatformat.locate(sized, turns)
    assert [text[s["text_start"] : s["text_end"]] for s in spans] == [t for _, t in turns] and all(s["located"] for s in spans)
    hashed = lambda turns: "".join(f"<{zlib.crc32(t.encode())}>{t}</>" for _, t in turns)
    _, spans = chatformat.locate(hashed, turns)
    assert [(s["located"], s["loss"], s["rewrites"]) for s in spans] == [(False, False, False)] * 2 + [(True, True, False)]
    upper = lambda turns: "".join(f"<{t[:4]}</>" for _, t in turns)
    assert not any(s["loss"] for s in chatformat.locate(upper, turns)[1][:2])


def test_chat_many_turns_repeats_and_null_ids(spark):
    import time

    def took(n):
        turns = [("assistant" if k % 2 else "user", f"turn {k} of a conversation that goes on") for k in range(n)]
        begin = time.perf_counter()
        text, spans = chatformat.locate(chatformat.Framed(), turns)
        assert chatformat.read_back(text) == turns and "".join(text[s["text_start"] : s["text_end"]] for s in spans if s["loss"]) == "".join(t for r, t in turns if r == "assistant")
        return time.perf_counter() - begin

    assert took(4000) < 40 * took(1000) + 1
    rows = [(None, 0, "assistant", "a")] * 40 + [(None, 1, "user", None)] + [(1, 0, "assistant", "same")] * 3
    table = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, lone int")
    got = chatformat.verified(chatformat.format_conversations(table)).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in got) == [(0, 1, 0)] + [(0, 1, 1)] * 40 + [(1, 3, 12)]


# ---- 5: toxicity ----------------------------------------------------------------------


def test_toxicity_learns_and_handles_edges(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    label = [k % 5 == 0 for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) + (" vile nasty" if y else "") for y in label]
    model = toxcnn.train(texts, [int(y) for y in label], epochs=6)
    fresh = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(50)]
    cache, table = toxcnn.Words(), [np.empty((0, toxcnn.DIM), np.float32)]
    assert (model.scores(fresh, cache, table) < 0.5).mean() > 0.9
    assert (model.scores([f + " vile" for f in fresh], cache, table) >= 0.5).mean() > 0.9
    scored = toxcnn.score(docs_of(spark, EDGE), model, ["doc_id", "spans"]).collect()
    assert len(scored) == len(EDGE) and all(0 <= r.score <= 1 for r in scored)
    assert scored[6].score == scored[7].score
    empty = toxcnn.train([], [])
    assert toxcnn.score(docs_of(spark, EDGE), empty, ["doc_id"]).where("score >= 0.5").count() == 0
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert toxcnn.fit_on(docs_of(spark, EDGE), labels) is not None


def plain_score(model, text):
    """One filter at one place at a time."""
    words = toxcnn.words_of(text)
    vectors = [sum(model.embed[r].astype(float) for r in toxcnn.slots_of(w)) for w in words]
    z, unit = float(model.bias), 0
    for width, filters, shift in zip(toxcnn.WIDTHS, model.filters, model.shift):
        for f in range(toxcnn.FILTERS):
            best = None
            for at in range(len(vectors)):
                x = shift[f]
                for j in range(width):
                    if at + j < len(vectors):
                        x += float(vectors[at + j] @ filters[j * toxcnn.DIM : (j + 1) * toxcnn.DIM, f])
                best = x if best is None or x > best else best
            z += max(best or 0, 0) * float(model.out[unit]) if vectors else 0
            unit += 1
    return 1 / (1 + np.exp(-(z - model.cut[toxcnn.language_of(words)])))


def test_toxicity_scores_match_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "und", "vile", "good", "é", "x1"]) for _ in range(rng.randrange(0, 30))) for _ in range(30)]
    model = toxcnn.train(texts, [int("vile" in t) for t in texts], epochs=2)
    monkeypatch.setattr(toxcnn, "CHUNK", 4)
    rows = [*texts, *texts[:5], None]
    got = toxcnn.score(docs_of(spark, rows).withColumnRenamed("id", "a.b"), model, ["doc_id", "a.b"]).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in got], [plain_score(model, t) for t in rows], atol=1e-4)
    assert [r.score for r in got[:5]] == [r.score for r in got[30:35]] and got[0]["a.b"] == "x"


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxcnn, "train", lambda texts, toxic: seen.append(texts))
    monkeypatch.setattr(toxcnn, "SAMPLE_CHARS", 100)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    toxcnn.fit_on(docs_of(spark, ["ten chars!"] * 60), labels, 20)
    monkeypatch.setattr(toxcnn, "SAMPLE_CHARS", 10**6)
    toxcnn.fit_on(docs_of(spark, ["ten chars!"] * 60), labels, 20)
    assert [len(t) for t in seen] == [10, 20]


def test_toxicity_is_fitted_on_every_labelled_row(spark, monkeypatch):
    """Rows beyond any sample are learnt from, in several shards; the same rows give the same model."""
    monkeypatch.setattr(toxcnn, "SAMPLE_CHARS", 500)
    monkeypatch.setattr(toxcnn, "SHARD_ROWS", 150, raising=False)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) + (" vile nasty" if k % 5 == 0 else "") for k in range(800)]
    texts[1] += "".join(f" once{k}" for k in range(9000))  # more words than the table of words starts with
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(800)], "doc_id long, toxic int")
    model = toxcnn.fit_on(docs, labels)
    cache, table = toxcnn.Words(), [np.empty((0, toxcnn.DIM), np.float32)]
    got = model.scores(texts, cache, table) >= 0.5
    assert (got == [k % 5 == 0 for k in range(800)]).mean() > 0.95
    again = toxcnn.fit_on(docs.repartition(3), labels.repartition(2))
    assert (again.embed == model.embed).all() and (again.cut == model.cut).all()


def test_language_of_counts_every_word():
    sentence = "house the of and to in is that for it was on with as by this from at".split()
    for repeats in (400, 1000):
        assert toxcnn.LANGUAGES[toxcnn.language_of(sentence * repeats)] == "en"


# ---- 6: search ------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["gauss", "ties", "huge"])
def test_top_k_matches_brute_force(spark, monkeypatch, kind):
    rng = np.random.default_rng(8)
    v = rng.normal(0, 1, (260, 6)) if kind != "ties" else np.ones((260, 6)) * rng.integers(0, 2, (260, 1))
    v = v * (2e6 if kind == "huge" else 1)
    rows = [(k, [float(x) for x in v[k]]) for k in range(260)]
    bad = [(260, None), (280, [1.0, None]), (300, [float("nan")]), (320, [float("inf"), 1.0]), (None, [1.0] * 6)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    for name, value in (("SHARD_BYTES", 48 * 64), ("QUERY_ROWS", 5), ("BLOCK", 3), ("LEAF", 8)):
        monkeypatch.setattr(balltree, name, value)
    got = balltree.top_k(table, F.expr("vec_id % 20 = 0"), 7).collect()
    whole = [[int(np.floor(64 * x)) for x in row] for row in v]
    for q in range(0, 260, 20):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[k])), k) for k in range(260) if k != q)[:7]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert mine == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert {r.query_id for r in got} == set(range(0, 260, 20))


def test_top_k_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0]), (20, [2.0, 3.0]), (5, [])], "vec_id long, embedding array<float>")
    got = balltree.top_k(table, F.expr("vec_id % 20 = 0")).collect()
    assert {(r.query_id, r.vec_id, r.score) for r in got} == {(0, 20, 64 * 128), (0, 5, 0), (20, 0, 64 * 128), (20, 5, 0)}
    assert balltree.top_k(table.limit(0), F.lit(True)).count() == 0
    assert balltree.top_k(table, F.lit(False)).count() == 0


def test_top_k_repeated_ids_and_rows(spark, monkeypatch):
    """Rows that share an id, or are equal, are rows of their own; only the own row is left out."""
    rng = np.random.default_rng(4)
    rows = [(int(k), [float(x) for x in rng.integers(-3, 4, 4)]) for k in rng.integers(0, 60, 150)]
    rows += [(40, [1.0, 2.0, 0.0, 1.0])] * 30 + [(k % 7 * 20, [1.0, 2.0, 0.0, 1.0]) for k in range(40)] + [(20, [9.0, 9.0]), (20, [9.0, 9.0])]
    table = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, key int, asked int")
    for name, value in (("SHARD_BYTES", 8 * 4 * 20), ("QUERY_ROWS", 6), ("BLOCK", 4), ("LEAF", 4)):
        monkeypatch.setattr(balltree, name, value)
    got = balltree.top_k(table, F.expr("vec_id % 20 = 0"), 5).collect()
    whole = [[int(64 * x) for x in v] for _, v in rows]
    want = []
    for q, (query, _) in enumerate(rows):
        if query % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), rows[c][0], c) for c in range(len(rows)) if c != q)[:5]
            want += [(query, n + 1, i, -s) for n, (s, i, _) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


# ---- 7 and 10: spans ------------------------------------------------------------------

E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
C = re.compile(r"[0-9]([\x20-]?[0-9])+")
P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in E.finditer(t)]
    out += [("ip", *m.span()) for m in I.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in C.finditer(t) if 13 <= len(digits(m)) <= 19 and skipcrf.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in P.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_pii_base_spans_match_the_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice("aB.@-+0123 1.2.3.4(%") for _ in range(rng.randrange(60)))
        assert [s[:3] for s in skipcrf.base_spans(t)] == plain_pii(t)


def test_pii_field_adds_and_redacts(spark):
    texts = [*EDGE, "mail a.b@mail.example.com or a.b@mail.example.com", "call +1 (017) 555-7713 now", "card 4111 1111 1111 1111", "ip 10.0.0.1!", "1 2 3"]
    docs = docs_of(spark, texts)
    got = skipcrf.detect(docs, ["doc_id"]).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == plain_pii(t or "")
    clean = skipcrf.redact(docs).orderBy("doc_id").collect()
    assert clean[10].text == "mail [EMAIL] or [EMAIL]" and clean[10].n_chars == len("mail [EMAIL] or [EMAIL]")
    assert clean[0].text is None and clean[14].text == texts[14] and clean[10].spans == "y"
    assert skipcrf.detect(docs.limit(0), ["doc_id"]).count() == 0


def test_skip_edges_carry_labels():
    texts = ["id 4111111111111111 seen; again 4111111111111111 end"] * 30 + ["number 7 and 12 of 90"] * 30
    model = skipcrf.fit(texts)
    nodes = skipcrf.nodes_of(0, "ref 4111111111111111 then 4111111111111111", [])
    nodes[0].clamp = skipcrf.LABELS.index("card")
    free = model.marginals([nodes[1]])[0]
    linked = model.marginals(nodes)[1]
    assert linked[skipcrf.LABELS.index("card")] >= free[skipcrf.LABELS.index("card")]


def test_beliefs_on_trees_are_exact():
    """Against the sum over all labellings: a chain whose ends are linked to leaves by skip edges."""
    rng = np.random.default_rng(7)
    m, n = len(skipcrf.LABELS), 5
    edges = [np.array([[0, 1], [1, 2]]), np.array([[0, 3]]), np.array([[2, 4]])]
    score, tables = rng.normal(0, 1, (n, m)), rng.normal(0, 1, (3, m, m))
    weight = np.zeros((m,) * n)
    for k in itertools.product(range(m), repeat=n):
        weight[k] = np.exp(sum(score[i, k[i]] for i in range(n)) + sum(tables[t, k[a], k[b]] for t, e in enumerate(edges) for a, b in e))
    weight /= weight.sum()
    belief, pairs = skipcrf.propagate(score, edges, tables, 60)
    for i in range(n):
        assert np.allclose(belief[i], weight.sum(tuple(j for j in range(n) if j != i)), atol=1e-6)
    assert np.allclose(pairs[0], weight.sum((2, 3, 4)) + weight.sum((0, 3, 4)), atol=1e-6)


def test_every_kind_of_edge_finds_disguised_values():
    """Trained with its edges, the field finds on held-out texts what patterns miss, and less without each kind."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    value = (lambda: f"{word()}{rng.randrange(99)}@{word()}.com", lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)), lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}")

    def text():
        parts = [word() if rng.random() < 0.9 else str(rng.randrange(3000)) for _ in range(40)]
        for _ in range(2):
            parts.insert(rng.randrange(40), rng.choice(value)())
        return " ".join(parts)

    model = skipcrf.fit([text() for _ in range(150)])
    held = [text() for _ in range(80)]
    found, strange = {}, 0
    for kinds in ((True, True, True), (False, True, True), (True, False, True), (True, True, False), (False, False, False)):
        found[kinds] = 0
        for t in held:
            other, spans = skipcrf.disguise(t, skipcrf.base_spans(t))
            both, shift = f"{t}\n{other}", len(t) + 1
            added = skipcrf.added_spans(model, [both], [skipcrf.base_spans(both)], kinds)[0]
            found[kinds] += sum(any(a[0] == s[0] and a[1] < s[2] + shift and a[2] > s[1] + shift for a in added) for s in spans)
            strange += sum(not any(a[1] < s[2] + shift and a[2] > s[1] + shift for s in spans) for a in added) if all(kinds) else 0
    whole = found.pop((True, True, True))
    assert whole >= 140 and strange <= 8 and max(found.values()) <= whole and found[False, False, False] < whole


def plain_secrets(t):
    rx = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [("assign", *m.span()) for m in rx.finditer(t) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secretscan.KINDS.index(s[0])))


def test_secrets(spark):
    rng = random.Random(6)
    pieces = ["token", "TOKEN ", "= ", ": ", '"', "password", "api_key", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "deadbeef", " ", "x", "ſecret"]
    texts = [*EDGE, *["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(300)]]
    got = secretscan.scan_secrets(docs_of(spark, texts), ["doc_id", "id"]).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == plain_secrets(t or "")
    assert secretscan.scan_secrets(docs_of(spark, []), ["doc_id"]).count() == 0


def test_novel_strings_are_reported():
    found = secretscan.find_secrets(["the secret is kept under Zx81kQp0LmT4sVb9aWq2 there", "the secret is configuration_version_2024 here", "nothing Zx81kQp0LmT4sVb9aWq2"])
    assert [[s[0] for s in x] for x in found] == [["novel"], [], []]


def test_novel_values_behind_names():
    value, padded = "wJalrXUtnFEMI/K7MDENG+bPxRfiCYzq8Lk3Vt0s", "Zx81kQp0LmT4sVb9aWq2Hd7f=="
    names = ["aws_secret_access_key=", "DB_PWD=", "signing_key=", "private_key=", "a=1=signing_key=", "secret_" + "long_name_" * 6 + "=", "signing_key = "]
    for name in names:
        for v in (value, padded):
            text = f"export {name}{v} # set"
            assert [text[s[1] : s[2]] for s in secretscan.find_secrets([text])[0]] == [v], text
    plain = ["export signing_key=configuration_version_2024", "colour=Zx81kQp0LmT4sVb9aWq2", "export DB_PWD=Zx81"]
    assert secretscan.find_secrets(plain) == [[], [], []]
    # parts too short to be candidates: measured whole, as without names
    assert [s[1:3] for s in secretscan.find_secrets(["the secret is Zx81kQp0LmT=4sVb9aWq2Hd there"])[0]] == [(14, 37)]


def test_identifiers_of_the_corpus_are_not_novel(spark):
    """The learned dictionary decides: without it the same string is reported."""
    name, random_name = "customerBilling.addressBook.recordV2x", "Zx81kQp0LmT4sVb9aWq2"
    texts = [f"use customerBilling.addressBook.record and {random_name} {k}" for k in range(20)] + [f"the key is {name} here", f"the key is {random_name} here", None, "", "Zx81.kQp0 " * 3000]
    docs = docs_of(spark, [*texts, texts[20]])
    dictionary = secretscan.learned(docs)
    assert b"customerBilling.addressBook.record" in dictionary and random_name.encode() not in dictionary
    kinds = lambda found: [[x.kind for x in r.spans] for r in found.orderBy("doc_id").collect()][20:]
    assert kinds(secretscan.scan_secrets(docs, ["doc_id"])) == [[], ["novel"], [], [], [], []]
    assert kinds(secretscan.scan_secrets(docs, ["doc_id"], dictionary=b"")) == [["novel"], ["novel"], [], [], [], ["novel"]]
    assert secretscan.learned(docs.limit(0)) == b""


def test_novelty_scores_base_spans_by_their_values():
    common, odd = secretscan.find_secrets(["password = production_environment_configuration", 'password = "q8Zk31LxPvT9sWm4"'])
    assert common[0][3] and odd[0][3] and common[0][4] < secretscan.NOVEL <= odd[0][4]


def test_novel_candidates_match_brute_force():
    """Every run of token characters, tried by itself, without the scan's cursors."""
    rng = random.Random(12)
    pieces = ["the", "key", "secret", "Zx81kQp0LmT4sVb9aWq2", "configuration_version_2024", "password=hunter2hunter2", "aB1" * 5, "deadbeef" * 4, "auth:", "x" * 60, "PWD", "Ab", "1234567890123"]
    for _ in range(300):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        base = secretscan.base_spans(text)
        want = []
        for m in secretscan.CANDIDATE.finditer(text):
            near = any(0 <= m.start() - w.end() <= secretscan.REACH for w in secretscan.CONTEXT.finditer(text))
            clear = not any(b < m.end() and e > m.start() for _, b, e, _, _ in base)
            mixed = any(c.isalpha() for c in m[0]) and (any(c.isdigit() for c in m[0]) or len(re.findall("[a-z][A-Z]", m[0])) > 2)
            around = text[max(0, m.start() - secretscan.AROUND) : m.start()] + " " + text[m.end() : m.end() + secretscan.AROUND]
            if "=" not in m[0] and near and clear and mixed and secretscan.novelty(m[0], around) >= secretscan.NOVEL:
                want.append(m.span())
        assert [s[1:3] for s in secretscan.novel_spans(text, base)] == want


# ---- 8: media -------------------------------------------------------------------------


def test_gif_round_trip(spark):
    docs = docs_of(spark, EDGE).withColumnRenamed("id", "a.b")
    got = media.play(media.encode(docs, ["doc_id", "a.b"]), ["doc_id", "a.b"]).orderBy("doc_id").collect()
    for r, t in zip(got, EDGE):
        stored = media.payload(t)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]), None)
        high = [0] * 8
        for x in stored:  # the canvas of a short last frame still shows the frame before below it
            high[gif.PALETTE[x][0] >> 5] += 1
        assert len(r.frames) > 1 or r.frames[0].red == high
    assert got[6].media_sha256 == got[7].media_sha256 and got[0]["a.b"] == "x"
    frames = media.decode(media.encode(docs_of(spark, EDGE), ["doc_id"]), ["doc_id"]).orderBy("doc_id").collect()
    assert len(frames[5].frames) == -(-50_048 // (64 * gif.FRAME_ROWS)) and frames[5].frames[0].delay_ms == 100
    assert media.encode(docs_of(spark, []), ["doc_id"]).count() == 0


def test_broken_gifs_fail_alone(spark):
    whole = gif.write_gif(media.payload("some text " * 4000))
    rows = [(0, whole), (1, whole[: len(whole) // 2]), (2, b"no gif at all"), (3, None), (4, b""), (5, whole[:6] + b"\xff" * 7), (6, whole), (7, whole[:-1])]
    short = bytearray(gif.write_gif(bytes(range(64)) * 4))
    short[short.index(b"\x2c") + 7] = 5  # one row more than the stream holds
    rows.append((8, bytes(short)))
    got = media.play(spark.createDataFrame([(k, v, 1) for k, v in rows], "k int, media binary, frames int"), ["k"]).orderBy("k").collect()
    assert [r.error is None for r in got] == [True, False, False, True, False, False, True, False, False]
    assert got[0].payload_sha256 == got[6].payload_sha256 and len(got[1].frames) < len(got[0].frames) == len(got[7].frames)
    assert got[3].frames == [] and got[3].payload_bytes is None
    assert [f.complete for f in got[8].frames] == [False] and "ends early" in got[8].error


def test_gif_random_bytes():
    rng = np.random.default_rng(0)
    for high in (2, 16, 256):
        data = rng.integers(0, high, 64 * 700, dtype=np.uint8).tobytes()
        frames, back, error = media.played(gif.write_gif(data))
        assert back == data and error is None and len(frames) == 3


def test_gif_disposal_transparency_and_local_palette():
    u16 = lambda *x: b"".join(v.to_bytes(2, "little") for v in x)

    def image(left, top, w, h, pixels, control, flags=b"\0", palette=b""):
        codes = np.array(pixels)
        bits = "".join(f"{c:03b}"[::-1] for c in [4])
        width, out, size = 3, [bits], 6
        for k, c in enumerate(codes):
            width = 3 if 5 + k < 8 else 4 if 5 + k < 16 else 5
            out.append(f"{c:0{width}b}"[::-1])
        width = 3 if 5 + len(codes) < 8 else 4 if 5 + len(codes) < 16 else 5
        out.append(f"{5:0{width}b}"[::-1])
        del size
        stream = "".join(out)
        stream += "0" * (-len(stream) % 8)
        data = bytes(int(stream[k : k + 8][::-1], 2) for k in range(0, len(stream), 8))
        return control + b"\x2c" + u16(left, top, w, h) + flags + palette + b"\x02" + bytes([len(data)]) + data + b"\0"

    head = b"GIF89a" + u16(2, 2) + b"\xf1\0\0" + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    control = lambda disposal, clear=None: b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + u16(5) + bytes([clear or 0]) + b"\0"
    data = head + image(0, 0, 2, 2, [1, 1, 1, 1], control(1)) + image(0, 0, 1, 1, [2], control(3)) + image(1, 1, 1, 1, [3], control(2)) + image(0, 0, 2, 1, [0, 2], control(0, 0)) + b"\x3b"
    red, green, blue, black = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)
    shown = [[tuple(p) for row in f.canvas.tolist() for p in row] for f in gif.read_gif(data)]
    assert shown == [[red] * 4, [green, red, red, red], [red, red, red, blue], [red, green, red, black]]
    with pytest.raises(ValueError):
        list(gif.read_gif(b"no gif at all"))


# ---- 9: pages -------------------------------------------------------------------------


def test_html_article_and_noise(spark):
    body = "This is the first of the paragraphs and it is long enough to be the kind of text that the rules take as good, with the usual words in it. " * 2
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Menu</a></nav><div class="ad">Buy it now and be the first of all.</div>
    <article><h1>Head&amp;line</h1><p>{body}<p>Short  one.<br>Two<!-- no --></p><div class="share"><a href=y>Share</a></div><script>var a="</p>"</script></article>
    <div class="comments"><p>{body}</p></div><footer>&copy; me</footer>"""
    want = "Head&line\n\n" + " ".join(body.split()) + "\n\nShort one. Two"
    rows = [(1, "u", page, "k"), (2, "u", None, "k"), (3, "u", "", "k"), (4, "u", "<" * 1000 + "<a href='", "k"), (5, "u", f"<div><p>{body}</p><p>ok then</p><p>{body}</p></div>", "k")]
    got = {r.page_id: r.text for r in htmlblocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), ["page_id"]).collect()}
    assert got[1] == want and got[2] == got[3] == "" and isinstance(got[4], str)
    assert got[5] == "\n\n".join([" ".join(body.split()), "ok then", " ".join(body.split())])


def test_html_wrappers_headers_and_hidden():
    body = "This is the first of the paragraphs and it is long enough to be the kind of text that the rules take as good, with the usual words in it. " * 2
    page = f"""<div class="content-sidebar-wrap"><article><div class="entry-header"><h1>Head</h1></div><p>{body}</p><p hidden>{body}</p><div style="display: none">x y</div><p>End.</p></article>
    <div class="site-header">{body}</div></div>"""
    assert htmlblocks.main_text(page) == "\n\n".join(["Head", " ".join(body.split()), "End."])


PROSE = "This is the first of the paragraphs and it is long enough to be the kind of text that the rules take as good, with the usual words in it. " * 2
LISTED = "Widget blue large 2024, gadget red small 2023, doohickey green medium 2022, thingamajig grey huge 2021, contraption pink tiny 2020 " * 2


def test_html_without_containers():
    """Neither pass can be left out where no element says what is the article."""
    page = f"<body><div><p>{LISTED}</p></div><div><h2>Head</h2><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p></div><div><p><a href=x>More about this and that and the other things here</a></p><p>Call us</p></div>"
    prose = " ".join(PROSE.split())
    assert htmlblocks.main_text(page) == "\n\n".join(["Head", prose, "Short one.", prose])


def test_html_passes_decide(monkeypatch):
    page = f"<body><article><p>{LISTED}</p><p><a href=x>{PROSE}</a></p><p>End.</p><p>{PROSE}</p></article><div>{LISTED}</div>"
    want = "\n\n".join(["End.", " ".join(PROSE.split())])
    assert htmlblocks.main_text(page) == want
    with monkeypatch.context() as m:
        m.setattr(htmlblocks, "stop_words", lambda text: (len(text.split()), len(text.split())))
        assert htmlblocks.main_text(page) != want
    monkeypatch.setattr(htmlblocks, "_second_pass", lambda blocks: None)
    assert htmlblocks.main_text(page) != want


def test_html_second_pass_matches_brute_force():
    """Nearest decided neighbours, looked for one by one."""
    rng = random.Random(3)

    def nearest(labels, k, step):
        while 0 <= (k := k + step) < len(labels):
            if labels[k] in ("good", "bad"):
                return k
        return None

    for _ in range(500):
        labels = [rng.choice(["good", "bad", "near", "thin", "short"]) for _ in range(rng.randrange(1, 12))]
        blocks = [htmlblocks.Block(text="x", label=x, container=rng.randrange(2), heading=rng.random() < 0.2) for x in labels]
        want = []
        for k, (label, b) in enumerate(zip(labels, blocks)):
            left, right = nearest(labels, k, -1), nearest(labels, k, 1)
            ends = {labels[i] for i in (left, right) if i is not None}
            if label in ("good", "bad"):
                want.append(label)
            elif not ends:
                want.append("good" if b.container or label == "near" else "bad")
            elif len(ends) == 1:
                want.append(ends.pop())
            elif b.heading and labels[right] == "good":
                want.append("good")
            elif k - left != right - k:
                want.append(labels[left] if k - left < right - k else labels[right])
            else:
                want.append("good" if label == "near" or b.container else "bad")
        htmlblocks._second_pass(blocks)
        assert [b.label for b in blocks] == want


def test_html_forms_languages_teasers_and_repeats(spark):
    prose = " ".join(PROSE.split())
    assert htmlblocks.main_text(f"<body><form action=x><p>{PROSE}</p><input name=q></form>") == prose
    assert htmlblocks.main_text(f"<body><p>{PROSE}</p><form><p>Name and mail</p></form>") == prose
    polish = "Wszystkie dzieci szybko pobiegły nad jezioro, gdzie czekały już łódki, wiosła oraz wielki kosz pełen jabłek, gruszek, śliwek i świeżego chleba z masłem od babci. " * 2
    assert htmlblocks.main_text(f"<div><p>{polish}</p></div><div><a href=x>{polish}</a></div>") == " ".join(polish.split())
    cards = f"<body><article><p>{PROSE}</p></article><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>"
    assert htmlblocks.main_text(cards) == "\n\n".join([prose] * 4)
    rows = [(1, "u", f"<p>{PROSE}</p>", 0)] * 2 + [(None, None, None, 1)]
    got = htmlblocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string, `a.b` int"), ["page_id"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, prose), (1, prose), (None, "")], key=str)
    assert htmlblocks.extract(spark.createDataFrame([], "page_id long, html string"), ["page_id"]).count() == 0


def test_html_time_is_linear():
    import time

    def took(n):
        begin = time.perf_counter()
        for piece in ('<a ">" ', "<p>", "<!", "<div class='", "< ", "&lt;<b>"):
            htmlblocks.main_text(piece * n)
        return time.perf_counter() - begin

    took(1000)
    assert took(40_000) < 12 * took(10_000) + 1
