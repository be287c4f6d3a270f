"""Quality rules, with verdicts on whole hosts.

A document fails by itself when it has fewer than ``min_words`` words or when
more than half of its words stand in repeated 3-word windows. Failures are then
counted by host; each host's failure rate is shrunk towards the mean of all
hosts by a beta prior fitted to the hosts themselves (method of moments), and a
host is rejected when its shrunk rate exceeds ``worst_rate``. Documents of
rejected hosts are dropped with it.

Null text has no words and fails. Null host is a host of its own. Repeated rows
count each time. An empty table gives no rows. The counts of one host are
summed before they are exchanged, so a host with a third of all rows is no
larger than another; verdicts (a row a host) join back by host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmere.llm._common import WS, as_bytes, slices, spread_join, stored

_NOT_SYMBOL = bytes(b for b in range(256) if b not in b"#*$%&|<>")


def repeated_window_words(words: list[bytes], n: int = 3) -> int:
    """Words that stand in an ``n``-word window found twice or more."""
    if len(words) <= n:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    v = len(number)
    key = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        key = key * v + ids[k : len(ids) - n + 1 + k]
        if k < n - 1 and v > 1_000_000:  # keep the product below 2**63
            key = np.unique(key, return_inverse=True)[1]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(ids), bool)
    for k in range(n):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def text_facts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = raw.split()
    packed = raw.translate(None, WS)
    chars = len(packed) if packed.isascii() else len(packed.decode("utf-8"))
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    repeated, seen = 0, set()
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line in seen:
                repeated += 1
            elif line.strip(WS):
                seen.add(line)
    return len(words), chars, symbols, repeated, repeated_window_words(words)


def facts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """``id_col``, host and the five counts of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            cols = list(zip(*(text_facts(t or b"") for t in as_bytes(batch.column("t"))))) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("host"), *(pa.array(c, pa.int64()) for c in cols)], ["i", "host", *NAMES])

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(df[id_col].alias("i"), (F.lit(None) if host is None else host).cast("string").alias("host"), df[text_col].alias("t"))
    return picked.mapInArrow(run, f"i {kind}, host string, {', '.join(n + ' long' for n in NAMES)}").withColumnRenamed("i", id_col)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def host_verdicts(failed: DataFrame, host_col: str = "host", failed_col: str = "base_failed", worst_rate: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_failed: a row for each host.

    The prior is beta(a, b) with the mean m of all documents. Of the spread of the
    hosts' rates around it (weighted by their documents), what documents drawn by
    chance would give is taken off, so that many small hosts don't look unlike
    each other: with N documents in M hosts of n each, and S the weighted sum of
    squares over m (1 - m), 1 / (a + b + 1) is (S - M + 1) / (N - sum n**2 / N - M + 1).
    a + b is held between 1 and 1000 (1000 where hosts don't differ).
    """
    hosts = failed.groupBy(failed[host_col].alias("host")).agg(F.count("*").alias("n_docs"), F.sum(failed[failed_col].cast("long")).alias("n_failed"))
    n, k = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    row = hosts.agg(F.count("*").alias("m"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(k * k / n).alias("sq"), F.sum(n * n).alias("nn")).first()  # one row
    mean, weight = (row["k"] / row["n"] if row["n"] else 0.0), 1000.0
    if 0 < mean < 1:
        room = row["n"] - row["nn"] / row["n"] - (row["m"] - 1)
        spread = (row["sq"] - row["n"] * mean * mean) / (mean * (1 - mean)) - (row["m"] - 1)
        if room > 1e-9 and spread > 1e-9:
            weight = max(1.0, min(1000.0, room / spread - 1))
    rate = (k + F.lit(mean * weight)) / (n + F.lit(weight))
    return hosts.select("host", "n_docs", "n_failed", rate.alias("shrunk_rate"), (rate > worst_rate).alias("host_failed"))


def rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, min_words: int = 50, worst_rate: float = 0.5) -> DataFrame:
    """``id_col``, the five counts, base_failed, host, its shrunk rate and verdict, kept: a row for each document."""
    told = facts(df, id_col, text_col, df["source"] if host is None and "source" in df.columns else host)
    told = stored(told.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "rules")
    verdict = host_verdicts(told, worst_rate=worst_rate).select(F.struct("host").alias("of"), "n_docs", "shrunk_rate", "host_failed")
    keyed = told.withColumn("of", F.struct("host"))
    joined = spread_join(keyed, verdict, ["of"], "n_docs")  # a host may hold a large share of all rows
    joined = (keyed.join(verdict, "of") if joined is None else joined).drop("of", "n_docs")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False)))
