"""Sinks: JSON lines, the table for people, exit status, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import glyphmere
from glyphmere.plans.axes import AXES

OK, NO_MATCH, USAGE = 0, 1, 2


def json_lines(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """value: each row as a JSON object, columns in order, doubles with four digits, undefined values as null; columns ``keep`` stay beside it."""
    shown = [F.col(f.name).cast("decimal(38,4)").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema if f.name not in keep]
    return df.select(*keep, F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_lines(df).write.mode(mode).text(path)


def table(row: Row, shown: list[str], label: str, message: str, norms: tuple[str, str] | None = None) -> str:
    lines = [f"{'normalized':<24} {norms[0]} / {norms[1]}"] if norms else []
    for k in shown:
        v = row[k]
        text = "n/a" if v is None else f"{v:.4f}" if AXES[k].kind == "double" else str(v).lower() if isinstance(v, bool) else str(v)
        lines.append(f"{k:<24} {text}")
    return "\n".join([*lines, "", f"[{label}] {message}"])


def provenance(spark: SparkSession) -> DataFrame:
    icu = spark.sparkContext._jvm.com.ibm.icu
    return spark.createDataFrame([("glyphmere", glyphmere.__version__), ("spark", spark.version), ("icu", icu.util.VersionInfo.ICU_VERSION.toString()), ("unicode", icu.lang.UCharacter.getUnicodeVersion().toString())], "part string, version string")
