"""Evaluation of detections against labelled pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["input", "match"]


def recall(labels: DataFrame, hits: DataFrame) -> DataFrame:
    """technique, hits, total, pct: by technique, and TOTAL. labels: input, match, technique."""
    found = labels.join(hits.select(*KEYS).distinct().withColumn("hit", F.lit(1)), KEYS, "left")
    out = found.rollup("technique").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count("*").alias("total"), F.grouping("technique").alias("all"))
    return out.select(F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("technique")).alias("technique"), "hits", "total", F.round(100 * F.col("hits") / F.col("total"), 1).alias("pct"))


def missed(labels: DataFrame, hits: DataFrame) -> DataFrame:
    return labels.join(hits.select(*KEYS).distinct(), KEYS, "left_anti")


def histogram(hits: DataFrame) -> DataFrame:
    return hits.groupBy("classification").agg(F.count("*").alias("n"))


def emitted(by_mode: dict[str, DataFrame]) -> DataFrame:
    """mode, n: rows kept by each mode."""
    frames = [df.select(F.lit(mode).alias("mode")) for mode, df in by_mode.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out.groupBy("mode").agg(F.count("*").alias("n"))


def haystack(*names: DataFrame) -> DataFrame:
    """Distinct values of several lists."""
    out = names[0].select("value")
    for n in names[1:]:
        out = out.unionAll(n.select("value"))
    return out.distinct()


def digest(df: DataFrame) -> DataFrame:
    """rows, digest: a fingerprint of the result that its order doesn't change (the sum of 60 bits of each row's MD5; values by tabs, nulls as \\N)."""
    row = F.md5(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns)))
    bits = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("digest"))
