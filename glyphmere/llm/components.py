"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmere.llm._common import forget, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Points each node's neighbours (those above it, or those below it and itself) to the least of them and it."""
    a, b = F.col("a"), F.col("b")
    if large:
        both = links.select(a.alias("u"), b.alias("v")).union(links.select(b.alias("u"), a.alias("v")))
    else:
        both = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    moved = joined.where(F.col("v") > F.col("u")) if large else joined
    out = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the component's least node) for every node of ``links`` (a, b: long).

    Nulls and links of a node to itself are ignored. Each round is written to the
    shared folder. Work is by node and link, so a hub costs its links once.
    """
    now = stored(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        after = stored(_star(_star(now, True), False), "links")
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        forget(now)
        now = after
        if before == (state["n"], state["h"]):
            break
        before = (state["n"], state["h"])
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
