"""Readers: name lists, pair lines, and public corpora in their published formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmere.functions.strings import trimmed


def names(spark: SparkSession, path: str) -> DataFrame:
    """value, ord of a newline-delimited list, trimmed, without empty lines. Lines that aren't UTF-8 stay, with replacement characters."""
    return spark.read.text(path).select(trimmed(F.col("value")).alias("value"), F.monotonically_increasing_id().alias("ord")).where("value <> ''")


def split_pairs(lines: DataFrame, col: str = "value", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(a, b) of lines cut at the first tab or comma, and (error, line) of those without one; empty lines are skipped. Columns ``keep`` stay."""
    cut = lines.where(F.col(col) != "").withColumn("__p", F.split(F.col(col), "[\t,]", 2))
    good = cut.where(F.size("__p") == 2).select(F.col("__p")[0].alias("a"), F.col("__p")[1].alias("b"), *keep)
    bad = cut.where(F.size("__p") < 2).select(F.lit("malformed line").alias("error"), F.col(col).alias("line"), *keep)
    return good, bad


def pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return split_pairs(spark.read.text(path))


def single_pair(spark: SparkSession, a: str, b: str) -> DataFrame:
    return spark.createDataFrame([(a, b)], "a string, b string")


def pypi_index(spark: SparkSession, path: str) -> DataFrame:
    """Names of the simple index as JSON."""
    return spark.read.schema("projects array<struct<name: string>>").json(path, multiLine=True).select(F.explode("projects.name").alias("value"))


def npm_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of a JSON array of strings."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("value"))


def top_packages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rows array<struct<project: string, download_count: bigint>>").json(path, multiLine=True).select(F.inline("rows")).select(F.col("project").alias("value"), "download_count")


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in ("malicious_package", "target_package", "ecosystem", "registry", "classification", "source"))
    return spark.read.csv(path, header=True, schema=schema)


def malicious_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct names of vulnerability records."""
    rows = spark.read.schema("affected array<struct<package: struct<name: string>>>").json(path, multiLine=True)
    return rows.select(F.explode("affected.package.name").alias("value")).distinct()
