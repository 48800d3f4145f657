"""The registered queries run over whole tables, and SQL gives the same rows where there is any."""

import duckdb
import pytest

from sievetext.llm import queries

SF = "/root/testdata/sf0.001"
KEYS = {
    "op1_minhash_neardup": ("documents", "doc_id"), "op2_grouped_packing": ("documents", "doc_id"), "op3_pfair_mixing": ("documents", "doc_id"), "op5_toxicity_cnn": ("documents", "doc_id"),
    "op7_skip_chain_pii": ("documents", "doc_id"), "op8_gif_media": ("documents", "doc_id"), "op9_two_pass_html": ("pages", "page_id"), "op10_zstd_secrets": ("documents", "doc_id"),
}


@pytest.mark.parametrize("name", KEYS)
def test_every_row_is_returned(spark, name):
    table, key = KEYS[name]
    got = queries.QUERIES[name](spark, SF).select(key).distinct().count()
    assert got == spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count()


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql_agrees(spark, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    with duckdb.connect() as c:
        for table in ("documents", "embeddings", "conversations"):
            c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
        wanted = c.execute(queries.ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    rows = lambda x: sorted(map(tuple, x[columns].astype(str).values.tolist()))
    assert rows(found) == rows(wanted)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs.count()
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert 0 < len(rows) <= seen
        docs, seen = spark.createDataFrame(rows, docs.schema), len(rows)
    assert p.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == seen


def test_pipeline_on_edge_cases(spark):
    """Null, empty, long, equal and repeated rows, and a column more, pass every stage."""
    import corpus_pipeline as p

    texts = [None, "", " ", "word", "x" * 20_000, "same five words right here", "same five words right here", "mail bob@corp.io please now ok"]
    rows = [(k, t, "en", None if k == 3 else "s", 0, "kept") for k, t in enumerate(texts)] + [(5, texts[5], "en", "s", 0, "kept"), (None, "no id here at all", "en", "s", 0, "kept"), (4, "another text under an id used before", "en", "s", 0, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `__key.x` string")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    kept = {r.doc_id: r for r in docs.collect()}
    assert sorted((r.doc_id for r in docs.collect()), key=str) == sorted([0, 1, 2, 3, 4, 4, 5, 7, None], key=str)
    assert kept[7].text == "mail [EMAIL] please now ok" and kept[7].n_chars == len(kept[7].text) and kept[5]["__key.x"] == "kept"
    assert p.STAGES[-1][1](spark, docs, SF).count() >= 9
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_sequences_follow_the_mixture(spark):
    """A document's sequence lies where the mixture has the document."""
    import corpus_pipeline as p
    from sievetext.llm import mixing, packing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    order = {r["doc_id"]: r["__mix_order"] for r in mixing.mix(docs).select("doc_id", "__mix_order").collect()}
    assert sorted(order.values()) == list(range(len(order)))
    packed = p.pack_sequences(spark, docs, SF).collect()
    assert {r.doc_id: r.mix_order for r in packed} == order
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append(r.mix_order)
    means = [sum(x) / len(x) // 1 for _, x in sorted(places.items())]
    assert means == sorted(means) and len(means) <= 1.02 * packing.pack(docs, p.tokenizer_path()).select("sequence_id").distinct().count() + 1
