"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetext.llm import balltree, chatformat, htmlblocks, media, mixing, neardup, packing, secretscan, skipcrf, spans, toxcnn
from sievetext.session import read_table, read_texts


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return neardup.near_duplicates(read_texts(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The public byte-level BPE file that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    return packing.pack(read_texts(spark, sf_dir, "documents"), tokenizer_path())


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, window, slot and place in the mixture of every document."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", *[F.col(f"__{c}").alias(c) for c in ("block", "release", "deadline", "slot", "mix_order")])


def op4_incremental_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, and of one made of control strings."""
    rows = read_table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    made = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chatformat.verified(chatformat.format_conversations(rows.unionByName(made)))


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and decision of every document."""
    docs = read_texts(spark, sf_dir, "documents")
    model = toxcnn.fit_on(docs, read_table(spark, sf_dir, "labels"))
    scored = toxcnn.score(docs, model, ["doc_id"])
    return scored.select("doc_id", toxcnn.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every row whose id is divisible by 20."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return balltree.top_k(vectors, F.col("vec_id") % 20 == 0)


def op7_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    found = skipcrf.detect(read_texts(spark, sf_dir, "documents"), ["doc_id"])
    counts = [spans.base_count(F.col("spans"), k).alias(f"n_{k}") for k in skipcrf.KINDS]
    return found.select("doc_id", *counts, spans.digest(F.col("spans")).alias("base_sha256"), spans.written(F.col("spans")).alias("spans"))


def op8_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's GIF and of the payload read back from it, and its frames' features."""
    docs = read_texts(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    found = media.play(media.encode(docs, ["doc_id", "n_bytes"]), ["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", media.summary(F.col("frames")).alias("feature"), "error")


def op9_two_pass_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = htmlblocks.extract(read_texts(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_zstd_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    found = secretscan.scan_secrets(read_texts(spark, sf_dir, "documents"), ["doc_id"])
    counts = [spans.base_count(F.col("spans"), k).alias(f"n_{k}") for k in secretscan.KINDS[:3]]
    return found.select("doc_id", *counts, spans.digest(F.col("spans")).alias("base_sha256"), spans.written(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_minhash_neardup": op1_minhash_neardup,
    "op2_grouped_packing": op2_grouped_packing,
    "op3_pfair_mixing": op3_pfair_mixing,
    "op4_incremental_chat": op4_incremental_chat,
    "op5_toxicity_cnn": op5_toxicity_cnn,
    "op6_ball_tree_topk": op6_ball_tree_topk,
    "op7_skip_chain_pii": op7_skip_chain_pii,
    "op8_gif_media": op8_gif_media,
    "op9_two_pass_html": op9_two_pass_html,
    "op10_zstd_secrets": op10_zstd_secrets,
}
ORACLES = {"op3_pfair_mixing": mixing.ORACLE, "op4_incremental_chat": chatformat.ORACLE, "op6_ball_tree_topk": balltree.ORACLE}
