"""Accuracy against labelled spans, and summary statistics.

Detections meet annotations of their document and type by greedy one-to-one matching in
detection order: each takes the free annotation of largest overlap (intersection over
union), if that reaches the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetext.functions.regexes import let

SPAN = "struct<type:string,start:int,end:int,confidence:double>"


def iou(a: Column, b: Column) -> Column:
    shared = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    union = (a["end"] - a["start"]) + (b["end"] - b["start"]) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def matched(detections: Column, annotations: Column, threshold: float = 0.5) -> Column:
    """For each detection the position (from 0) of its annotation, or -1."""
    places = F.sequence(F.lit(0), F.size(annotations) - 1)

    def step(taken: Column, d: Column) -> Column:
        def candidate(i: Column) -> Column:
            return let(F.element_at(annotations, i + 1), lambda a: F.struct(F.when((a["type"] == d["type"]) & ~F.array_contains(taken, i), iou(d, a)).otherwise(-1.0).alias("o"), (-i).alias("k")))

        best = F.when(F.size(annotations) > 0, F.array_max(F.transform(places, candidate)))
        return F.concat(taken, F.array(let(best, lambda b: F.when(b["o"] >= threshold, -b["k"]).otherwise(-1))))

    return F.aggregate(detections, F.expr("cast(array() as array<int>)"), step)


def judge(docs: DataFrame, detections: str = "hits", annotations: str = "annotations", threshold: float = 0.5) -> DataFrame:
    """One row for each true positive, false positive and false negative: doc columns, outcome, type, confidence."""
    if not threshold:
        threshold = 0.5
    keep = [c for c in docs.columns if c not in (detections, annotations)]
    placed = docs.withColumn("__m", matched(F.col(detections), F.col(annotations), threshold))
    hits = F.zip_with(detections, "__m", lambda d, m: F.struct(F.when(m >= 0, "tp").otherwise("fp").alias("outcome"), F.when(m >= 0, F.try_element_at(annotations, m + 1)["type"]).otherwise(d["type"]).alias("type"), d["confidence"].alias("confidence")))
    places = F.when(F.size(annotations) > 0, F.sequence(F.lit(0), F.size(annotations) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    missed = F.transform(F.array_except(places, "__m"), lambda i: F.struct(F.lit("fn").alias("outcome"), F.element_at(annotations, i + 1)["type"].alias("type"), F.lit(None).cast("double").alias("confidence")))
    return placed.select(*keep, F.inline(F.concat(hits, missed)))


def _rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return [p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1.0))).alias("f1")]


def metrics(judged: DataFrame, by: list[str] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall, F1 and mean confidences, over all or by columns.

    F1 divides by at least 1, which understates it where precision plus recall is below 1.
    """
    count = lambda o: F.count_if(F.col("outcome") == o)
    mean = lambda o: F.coalesce(F.avg(F.when(F.col("outcome") == o, F.col("confidence"))), F.lit(0.0))
    out = judged.groupBy(*by).agg(count("tp").alias("tp"), count("fp").alias("fp"), count("fn").alias("fn"), mean("tp").alias("confidence_tp"), mean("fp").alias("confidence_fp"))
    return out.select(*by, "tp", "fp", "fn", *_rates(F.col("tp"), F.col("fp"), F.col("fn")), "confidence_tp", "confidence_fp")


def confidence_histogram(judged: DataFrame) -> DataFrame:
    """Count and precision in four confidence buckets; empty ones are there too."""
    bucket = F.when(F.col("confidence") < 0.25, 0).when(F.col("confidence") < 0.5, 1).when(F.col("confidence") < 0.75, 2).otherwise(3)
    seen = judged.where("outcome <> 'fn'").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "tp").alias("tp"))
    every = judged.sparkSession.range(4).select(F.col("id").cast("int").alias("bucket"))
    out = every.join(seen, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("tp", F.lit(0)).alias("tp"))
    return out.withColumn("precision", F.col("tp") / F.greatest(F.col("n"), F.lit(1)))


def broken_annotations(docs: DataFrame, text: str = "text", annotations: str = "annotations") -> DataFrame:
    """Annotations out of bounds, beginning before an earlier one has ended, or not equal to their text."""
    order = F.array_sort(F.transform(annotations, lambda a: F.struct(a["start"], a["end"], a["type"], a["value"])))
    # the furthest end so far, so that a short one inside a long one does not hide the long one
    ends = F.transform(order, lambda a, k: F.struct(a.alias("a"), F.array_max(F.transform(F.slice(order, 1, k), lambda b: b["end"])).alias("before")))
    rows = docs.select("*", F.explode_outer(ends).alias("__x")).where("__x IS NOT NULL").select("*", F.col("__x.a").alias("a"), F.col("__x.before").alias("__before"))
    start, end = F.col("a.start"), F.col("a.end")
    why = F.when((start < 0) | (end <= start) | (end > F.length(text)), "bounds").when(F.col("__before") > start, "overlap").when(F.substring(F.col(text), start + 1, end - start) != F.col("a.value"), "value")
    return rows.withColumn("why", why).where("why IS NOT NULL").drop("__x", "__before", annotations)


def summary(df: DataFrame, value: str, by: list[str] = (), accuracy: int | None = None) -> DataFrame:
    """count, mean, median, sample deviation, min, max and the 25th, 75th and 95th percentiles.

    Exact percentiles count a group's distinct values in one task; all four share that count. With
    ``accuracy`` they are approximate, of bounded size, with relative rank error 1 / accuracy.
    """
    v, at = F.col(value), F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 0.95)])
    places = F.percentile(v, at) if accuracy is None else F.percentile_approx(v, at, accuracy)
    out = df.groupBy(*by).agg(
        F.count(v).alias("count"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_dev"), F.min(v).alias("min"), F.max(v).alias("max"), places.alias("__p"),
    )
    named = [F.col("__p")[k].alias(n) for k, n in ((1, "median"), (0, "p25"), (2, "p75"), (3, "p95"))]
    return out.select(*by, "count", "mean", named[0], "std_dev", "min", "max", *named[1:])


#: Fixed critical values that the interval uses.
SMALL_T, T95, T99 = 1.96, 1.645, 1.96


def confidence_interval(df: DataFrame, value: str, level: float = 0.95, by: list[str] = ()) -> DataFrame:
    """mean, margin, lower, upper; from 30 degrees of freedom on the one-sided 5 % value counts for 95 %."""
    v = F.col(value)
    out = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("s"))
    t = F.when(F.col("n") - 1 >= 30, T99 if level >= 0.99 else T95).otherwise(SMALL_T)
    margin = t * F.col("s") / F.sqrt("n")
    return out.select(*by, "mean", margin.alias("margin"), (F.col("mean") - margin).alias("lower"), (F.col("mean") + margin).alias("upper"))


def rough_p_value(t: Column, df: Column) -> Column:
    """0.5 up to t = 1, 0.001 beyond 4, an exponential between; larger for fewer than 10 degrees of freedom."""
    factor = F.when(df > 10, 1.0).otherwise(1 + (10 - df) * 0.1)
    return F.when(t < 1, 0.5).when(t > 4, 0.001).otherwise(F.greatest(F.lit(0.001), 0.5 * F.exp(-t * factor)))


def t_test(df: DataFrame, value: str, group: str, first, second, alpha: float = 0.05) -> DataFrame:
    """Pooled two-sample t statistic, degrees of freedom, rough p-value and whether it is under ``alpha``.

    With fewer than two values on a side t is 0 and p is 1; so is t without any spread.
    """
    part = lambda g: F.when(F.col(group) == g, F.col(value))
    stats = df.agg(*[f(part(g)).alias(f"{n}{k}") for k, g in ((1, first), (2, second)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    error = F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    enough = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    t = stats.select(enough.alias("enough"), F.greatest(F.lit(0), F.col("n1") + F.col("n2") - 2).alias("df"), F.when(enough & (error > 0), (F.col("m1") - F.col("m2")) / error).otherwise(0.0).alias("t"))
    t = t.withColumn("p", F.when(F.col("enough"), rough_p_value(F.abs("t"), F.col("df"))).otherwise(1.0))
    return t.select("df", "t", "p", (F.col("p") < alpha).alias("significant"))


def trust_counts(scanned: DataFrame, segments: str = "segments", by: list[str] = ()) -> DataFrame:
    """Segments of each trust level, and their characters."""
    one = scanned.select(*by, F.explode_outer(segments).alias("s")).where("s IS NOT NULL")
    return one.groupBy(*by, F.col("s.trust").alias("trust")).agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("s.content")).cast("long").alias("chars"))


def benchmark_summary(runs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Of runs (chars, ms, bytes): how many, characters and runs a second, memory, and how time goes with size."""
    out = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.sum("chars").alias("__chars"), F.sum("ms").alias("__ms"), F.avg("bytes").alias("mean_bytes"), F.max("bytes").alias("most_bytes"), F.corr("chars", "ms").alias("__r"))
    second = F.greatest(F.col("__ms"), F.lit(1e-9)) / 1000
    return out.select(*by, "runs", (F.col("__chars") / second).alias("chars_per_s"), (F.col("runs") / second).alias("runs_per_s"), "mean_bytes", "most_bytes", F.coalesce(F.nanvl("__r", F.lit(0.0)), F.lit(0.0)).alias("size_time_r"))


def large_text(scanned: DataFrame, threshold: float = 60, by: list[str] = ()) -> DataFrame:
    """A text scanned in chunks: safe if its mean risk is under the threshold."""
    out = scanned.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"), F.avg("risk").alias("mean_risk"), F.max("risk").alias("highest_risk"), F.sum(F.size("matches")).cast("long").alias("matches"))
    return out.withColumn("safe", F.col("mean_risk") < threshold)


#: How named metrics are combined.
METRICS = {"sum": F.sum, "average": F.avg, "max": F.max, "min": F.min, "count": F.count}


def metric(rows: DataFrame, kind: str, by: list[str] = (), value: str = "value", edges: tuple[float, ...] = ()) -> DataFrame:
    """One metric by columns; a histogram counts the values up to each edge, and all as the last."""
    if kind == "histogram":
        counts = [F.count_if(F.col(value) <= e).cast("long") for e in edges]
        return rows.groupBy(*by).agg(F.array(*counts, F.count(value)).alias(kind))
    return rows.groupBy(*by).agg(METRICS[kind](value).alias(kind))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0)).alias("r"))
