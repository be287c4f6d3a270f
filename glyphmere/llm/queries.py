"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmere.llm._common import crc_mod, documents, tokenizer_file


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmere.llm import katz

    told = katz.score(documents(spark, sf_dir), crc_mod("doc_id", 7) != 2)
    return told.withColumn("held_out", ~F.col("learned")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_line_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmere.llm import line_suffixes

    found = line_suffixes.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_cut", "runs", F.sha2(F.coalesce("rest", F.lit("")), 256).alias("rest_sha256"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmere.llm import fingerprints

    return fingerprints.with_next(documents(spark, sf_dir))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmere.llm import host_rules

    told = host_rules.rules(documents(spark, sf_dir))
    return told.withColumn("shrunk_rate", F.round("shrunk_rate", 6))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmere.llm import license_scan

    return license_scan.scan(documents(spark, sf_dir))


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmere.llm import chosen_path

    return chosen_path.join(documents(spark, sf_dir))


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmere.llm import language_crf

    docs = documents(spark, sf_dir)
    model = language_crf.train(docs, crc_mod("doc_id", 5) != 0)
    told = language_crf.predict(docs.select("doc_id", "text"), model)
    return told.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmere.llm import forced_bpe

    return forced_bpe.digests(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmere.llm import compact_windows

    found = compact_windows.find_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_cut", "repeats", F.sha2(F.coalesce("rest", F.lit("")), 256).alias("rest_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmere.llm import packing

    return packing.pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz": op1_katz,
    "op2_line_suffixes": op2_line_suffixes,
    "op3_fingerprints": op3_fingerprints,
    "op4_host_rules": op4_host_rules,
    "op5_license_scan": op5_license_scan,
    "op6_chosen_path": op6_chosen_path,
    "op7_language_crf": op7_language_crf,
    "op8_forced_bpe": op8_forced_bpe,
    "op9_compact_windows": op9_compact_windows,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op4_host_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT r, sum(n - 1) AS n_dup FROM (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
c AS (SELECT r, count(DISTINCT p) AS n_rep FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY r),
f AS (SELECT d.r, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in ws]), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w ON d.r = w.r LEFT JOIN l ON d.r = l.r LEFT JOIN c ON d.r = c.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT host, count(*) AS n, sum(CAST(base_failed AS INT)) AS k FROM b GROUP BY host),
m AS (SELECT sum(k) / sum(n) AS mean, count(*) - 1 AS others, sum(n) - sum(CAST(n AS DOUBLE) * n) / sum(n) AS mixed, sum(CAST(k AS DOUBLE) * k / n) - sum(n) * (sum(k) / sum(n)) * (sum(k) / sum(n)) AS spread FROM h),
s AS (SELECT mean, mixed - others AS room, CASE WHEN mean > 0 AND mean < 1 THEN spread / (mean * (1 - mean)) - others ELSE 0 END AS excess FROM m),
q AS (SELECT mean, CASE WHEN room > 1e-9 AND excess > 1e-9 THEN greatest(1, least(1000, room / excess - 1)) ELSE 1000 END AS weight FROM s),
v AS (SELECT host, (k + mean * weight) / (n + weight) AS rate FROM h, q)
SELECT doc_id, b.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS shrunk_rate, rate > 0.5 AS host_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM b JOIN v ON b.host IS NOT DISTINCT FROM v.host""",
}
