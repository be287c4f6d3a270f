"""Small pieces that several training-data operators share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; ``bytes.split()`` without arguments cuts at exactly these.
WS = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(id_col: str, modulus: int):
    """crc32 of an id's decimal text modulo ``modulus`` (-1 for a null id, which so never is held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus), F.lit(-1))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def release() -> None:
    """Gives memory that a Python worker has freed back to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 16 << 20, most_rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds about ``most_bytes`` each; one long row may exceed it. After the last, freed memory is given back."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            held += n or 0
            if held >= most_bytes or i + 1 - start >= most_rows:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch
    release()


#: Seconds between the driver's collections of garbage after stored tables.
COLLECT_EVERY = 5
_collected = 0.0
#: Rows of one key that any task may take, whatever their share.
OFTEN = 10_000


class Recent(dict):
    """A bounded memo: ``make(key)`` fills it, and of older entries those used again since stay."""

    def __init__(self, make: Callable, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one made here if driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = got.get() if got.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="glyphmere-")
        spark.sparkContext.setCheckpointDir(folder)
    return re.sub(r"/+$", "", folder)


def drop_shuffles(spark: SparkSession, after: float = COLLECT_EVERY) -> None:
    """Collects the driver's garbage, ``after`` so many seconds since the last time: then Spark drops the shuffle files of plans that are gone."""
    global _collected
    if time.monotonic() - _collected > after:
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def stored(df: DataFrame, what: str, packed: bool = False) -> DataFrame:
    """``df`` written to a table in the shared folder and read back, which cuts its lineage and survives lost executors.

    ``packed``: its values are long and compressed already. Compressing pages of
    them again would only fill the direct memory of the JVM.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/glyphmere/{what}-{uuid.uuid4().hex}"
    drop_shuffles(spark)
    _made.add(path)
    df.write.parquet(path, compression="uncompressed" if packed else None)
    del df
    drop_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def often_of(groups: DataFrame, size: str = "n") -> tuple[int, int]:
    """How many rows of a key are a large share (1 in ``4 * partitions`` of all rows, so that at most as many keys have more; at least ``OFTEN``), and the most that a key has (0 without any)."""
    state = groups.agg(F.sum(size).alias("total"), F.max(size).alias("largest")).first()
    return max((state["total"] or 0) // (4 * parts_of(groups.sparkSession)), OFTEN), state["largest"] or 0


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str = "n") -> DataFrame | None:
    """Inner join of stored ``rows`` with ``groups``, which has one row a key; ``size`` is the number of rows of the key. None if there are no groups.

    Keys that hold a large share of all rows, of which there are at most
    ``4 * partitions``, are joined by broadcast. So no task gets all rows of a hot key.
    """
    often, largest = often_of(groups, size)
    if largest <= often:
        return rows.join(groups, keys) if largest else None
    hot = F.broadcast(groups.where(F.col(size) > often))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col(size) <= often), keys)
    return rows.join(hot, keys).unionByName(rest)


#: Tables that ``stored`` made in this process and nothing has deleted yet.
_made: set[str] = set()


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this process made by ``stored``; for use when the results that read them have been read or written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def placed(spark: SparkSession, n: int) -> list[int]:
    """For each i below ``n``, a long that ``repartition(n, ...)`` deals to partition i."""
    found: dict[int, int] = {}
    for row in spark.range(0, 40 * n + 200, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("at")).collect():
        found.setdefault(row["at"], row["id"])
    return [found.get(i, i) for i in range(n)]
