"""Bounds of what goes to Python at once, for functions on texts and pages."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

_libc = ctypes.CDLL(None)
#: Rows that go to Python at once: ten thousand, Spark's default, are tens of MB of texts on either side, and many times that as elements.
BATCH_ROWS = 500


def small_batches(spark: SparkSession | None) -> None:
    """From now on Arrow batches of the session have BATCH_ROWS rows at most: Spark reads it when a plan runs, so it can't be set for one call."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def released() -> None:
    """Gives memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc, "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
