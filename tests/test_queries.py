"""Every registered query against its SQL, and those without SQL for whole results."""

import re

import duckdb
import pytest

from sievetext import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as c:
        for table in ("documents", "conversations", "customer", "orders", "lineitem", "events", "nation"):
            c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
        yield c


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql_agrees(spark, duck, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    wanted = duck.execute(queries.ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    rows = lambda x: sorted(map(tuple, x[columns].astype(str).values.tolist()))
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", ["guard_sanitize_injected", "guard_strict_level"])
def test_every_document_is_returned(spark, name):
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_every_term_is_looked_for_in_every_document(spark, tmp_path):
    """Against brute force: the table, and texts beyond ASCII, with many matches, of one term each."""
    texts = ["the of " * 250, "é THE  of it", "dice que\u00a0la casa, QUE la", "the\u3000of que la", "theé the ofé", "none", "", None, "_the of", "the of_"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    edge = {(0, "term_a", 250), (1, "term_a", 1), (2, "term_b", 2), (3, "term_a", 1), (3, "term_b", 1), (4, "term_a", 1)}
    assert set(map(tuple, queries.QUERIES["dictionary_hits"](spark, str(tmp_path)).collect())) == edge
    terms = {"term_a": r"\bthe\s+of\b", "term_b": r"\bque\s+la\b"}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", queries.T.normalize(queries.F.col("text")).alias("s")).collect()
    want = {(d.doc_id, t, n) for d in docs for t, p in terms.items() if (n := len(re.findall(p, d.s or "", re.I | re.A)))}
    assert {t for _, t, _ in want} == set(terms)
    assert set(map(tuple, queries.QUERIES["dictionary_hits"](spark, SF).collect())) == want


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
