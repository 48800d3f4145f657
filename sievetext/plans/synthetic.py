"""Labelled texts made up from a seed, for benchmarks and accuracy tests: no randomness, any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetext.functions.regexes import let

#: Personal data by type, and plain words.
VALUES = (
    ("email", "user@company.com"), ("email", "admin@service.org"), ("email", "contact@startup.io"), ("email", "hello@domain.com"),
    ("credit_card", "4111111111111111"), ("credit_card", "5555555555554444"), ("credit_card", "378282246310005"),
    ("ipv4", "203.0.113.1"), ("phone_jp", "090-1234-5678"), ("phone_jp", "03-1234-5678"),
)
WORDS = "the quick brown fox jumps over lazy dog lorem ipsum dolor sit amet consectetur adipiscing elit technology system".split()
LABELLED = "array<struct<start:int,end:int,type:string,value:string>>"


def entries(spark: SparkSession, rows: int, words: int = 40, density: float = 0.1, seed: int = 0, types: tuple[str, ...] = ("email", "credit_card")) -> DataFrame:
    """(id, text, annotations): texts of ``words`` words, of which about ``density`` are personal data of the types."""
    values = [v for v in VALUES if v[0] in types]
    hits, plain = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in values]), F.array(*[F.lit(w) for w in WORDS])

    def word(k: Column) -> Column:
        h = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), k), F.lit(1_000_000))
        personal = F.get(hits, (h % max(len(values), 1)).cast("int"))
        other = F.struct(F.lit(None).cast("string").alias("type"), F.get(plain, (h % len(WORDS)).cast("int")).alias("value"))
        return F.when(F.lit(bool(values)) & (h < int(density * 1_000_000)), personal).otherwise(other)

    def place(s: Column, w: Column) -> Column:
        end = s["at"] + F.length(w["value"])
        label = F.array(F.struct(s["at"].alias("start"), end.alias("end"), w["type"].alias("type"), w["value"].alias("value")))
        return F.struct((end + 1).alias("at"), F.when(w["type"].isNotNull(), F.concat(s["out"], label)).otherwise(s["out"]).alias("out"))

    made = spark.range(rows).withColumn("__w", F.transform(F.sequence(F.lit(1), F.lit(words)), word))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {LABELLED})").alias("out"))
    labels = let(F.aggregate("__w", start, place), lambda s: s["out"])
    return made.select(F.col("id").cast("string").alias("id"), F.array_join(F.transform("__w", lambda w: w["value"]), " ").alias("text"), labels.alias("annotations"))
