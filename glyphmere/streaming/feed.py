"""Continuous scoring of a stream of pair lines or names; stateless, append mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from glyphmere.plans.pairs import Config, score, watchlist
from glyphmere.sources.readers import split_pairs
from glyphmere.sources.writers import json_lines


def pair_stream(spark: SparkSession, folder: str, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Scored pairs and malformed lines of text files that arrive in a folder."""
    good, bad = split_pairs(spark.readStream.text(folder))
    return score(good, cfg=cfg, gate=True), bad


def start_json(df: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    return json_lines(df).writeStream.format("text").option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start(out)


def ranked_batches(names: DataFrame, query: str, cfg: Config, checkpoint: str, sink: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
    """Ranks each micro-batch of a stream of names (value) against a query: sorting needs an end."""

    def each(batch: DataFrame, number: int) -> None:
        sink(watchlist(batch, query, cfg), number)

    return names.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
