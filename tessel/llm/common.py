"""Helpers shared by the training-data operators: the shared folder, stored tables, bounded broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_libc = ctypes.CDLL(None)
#: Rows of texts that go to Python at once: ten thousand, Spark's default, are tens of MB on either side.
TEXT_BATCH_ROWS = 500
#: Rows that a broadcast side may have at most; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessel-"))
        found = spark.sparkContext.getCheckpointDir()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessel/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keep_ids(df: DataFrame, ids: DataFrame, on: str, n_ids: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``ids``: broadcast if ``ids`` has at most BROADCAST_ROWS rows, else shuffled."""
    n = ids.count() if n_ids is None else n_ids
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, on, "left_semi")


_held: dict = {}


def held(key, make):
    """What a Python worker keeps between tasks, made if it isn't there: one thing at a time, so that operators that follow each other in a worker don't add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def released(others: bool = False) -> None:
    """Gives memory that is free back to the system; with ``others``, what operators before kept in this worker too."""
    if others:
        _held.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc, "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, mod ``n``; null stays null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in whose session Arrow batches have TEXT_BATCH_ROWS rows at most from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= TEXT_BATCH_ROWS:
        df.sparkSession.conf.set(key, str(TEXT_BATCH_ROWS))
    return df
