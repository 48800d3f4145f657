"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written
as Parquet and read again. All but the last return the columns of ``documents``.

1. toxicity: documents that the classifier scores 0.5 or more go;
2. minhash_neardup: of each near-duplicate group the row with the smallest id stays;
3. pii: spans are replaced by their kind, ``n_chars`` follows;
4. mixing: rows are written in the order of the source mixture;
5. packing: pieces of at most 1024 tokens with their sequence and offset. Documents are packed
   within windows of the mixture, and sequence ids rise along it.

The mixture's place of a row depends on its id and on its source's size alone, so the packer
finds the same places again and needs no further column.

Documents with null or empty text pass every stage (the packer gives them their end id), and
so do rows without an id. Rows that share an id but not a text are judged each by its own text;
of rows alike in both one stays. Very long texts are handled whole, in the one task that holds
them. Extra columns are carried along, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetext.llm import mixing, neardup, packing, skipcrf, toxcnn
from sievetext.llm.queries import tokenizer_path
from sievetext.session import checkpoint_dir, cut_lineage, read_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    model = toxcnn.fit_on(docs, read_table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return toxcnn.score(whole, model, ["doc"]).where("score < 0.5").select("doc.*")


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group."""
    return neardup.one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with personal data replaced by its kind."""
    return skipcrf.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` in the order of the source mixture."""
    return mixing.in_mix_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence, along the mixture."""
    cut = cut_lineage(packing.tokenised(docs, tokenizer_path(), ["doc_id", "source"]))
    return packing.pack_windows(mixing.placed(cut).select("doc.doc_id", "doc.pieces", "mix_order"), "mix_order")


STAGES = [("toxicity", toxicity), ("minhash_neardup", minhash_neardup), ("pii", pii), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL can express neither the classifier nor the tokeniser.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder, wherever that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table lies in the shared checkpoint folder until the next is written."""
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            _remove(spark, last)
        last = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
