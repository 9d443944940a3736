"""A keyed table: upserts, insert-or-ignore, deletes and reads through a time to live, by bucket.

Rows lie in buckets of their key's hash. A change reads the buckets that it touches, merges, writes the result beside the
table and then replaces the buckets (dynamic partition overwrite). A change that broke off is done again from what was
written beside, under its name; so one that is tried twice counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Store:
    """A table at ``path`` with ``schema`` (DDL) and one row for each ``key``; ``combine`` makes a row of all rows of a key, as aggregates of its columns; without it the last one given stays."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    combine: tuple[Column, ...] = ()
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self) -> DataFrame:
        """All rows; none where nothing was written yet."""
        return self._read().drop("bucket")

    def _read(self) -> DataFrame:
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self.schema + ", bucket int")
        return self.spark.read.schema(self.schema + ", bucket int").parquet(self.path)

    def _columns(self) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], self.schema).schema]

    def _replace(self, change: Callable[[DataFrame, DataFrame], DataFrame], batch: DataFrame, name: str | None) -> None:
        """Replaces the buckets of the batch's keys by what ``change(old, batch)`` makes of them, once for each name."""
        staged = f"{self.path}-changes/{name or uuid.uuid4().hex}"
        if self._exists(f"{staged}/applied"):
            return
        if not self._exists(f"{staged}/rows/_SUCCESS"):
            rows = batch.withColumn("bucket", self._bucket())
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # as many as there are buckets at most
            old = self._read().where(F.col("bucket").isin(touched))
            kept = change(old, rows)
            # a bucket that is left without rows is written with a row of nulls, which readers leave out
            marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
            empty = marks.join(kept.select("bucket").distinct(), "bucket", "left_anti")
            typed = [F.col(f.name).cast(f.dataType) for f in old.schema]
            kept.unionByName(empty, allowMissingColumns=True).select(*typed).write.mode("overwrite").parquet(f"{staged}/rows")
        rows = self.spark.read.schema(self.schema + ", bucket int").parquet(f"{staged}/rows")
        # few files a bucket, but a large bucket is written by several tasks
        rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        self.spark.range(1).write.mode("overwrite").parquet(f"{staged}/applied")

    def upsert(self, batch: DataFrame, name: str | None = None) -> None:
        """Merges rows into the table. Rows of a key meet by ``combine``; without it the batch's row replaces the table's (of several, any)."""

        def change(old: DataFrame, rows: DataFrame) -> DataFrame:
            rows = rows.where(F.col(self.key).isNotNull())
            if self.combine:
                both = old.where(F.col(self.key).isNotNull()).unionByName(rows, allowMissingColumns=True)
                return both.groupBy("bucket", self.key).agg(*self.combine).select(*self._columns(), "bucket")
            return self._without(old, rows).unionByName(rows.dropDuplicates([self.key]).select(*self._columns(), "bucket"))

        self._replace(change, batch, name)

    def _without(self, old: DataFrame, rows: DataFrame) -> DataFrame:
        return old.where(F.col(self.key).isNotNull()).join(rows.select(self.key).distinct(), self.key, "left_anti").select(*self._columns(), "bucket")

    def insert_or_ignore(self, batch: DataFrame, name: str | None = None) -> None:
        """Adds rows whose key is new; of several of one key, any."""

        def change(old: DataFrame, rows: DataFrame) -> DataFrame:
            mine = old.where(F.col(self.key).isNotNull())
            fresh = rows.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]).join(mine.select(self.key), self.key, "left_anti")
            return mine.select(*self._columns(), "bucket").unionByName(fresh.select(*self._columns(), "bucket"))

        self._replace(change, batch, name)

    def delete(self, keys: DataFrame, name: str | None = None) -> int:
        """Deletes the rows of keys; tells how many there were."""
        found = self.rows().join(keys.select(self.key).distinct(), self.key, "left_semi").count()
        if found:
            self._replace(self._without, keys.select(self.key), name)
        return found

    def rows(self) -> DataFrame:
        """The rows as they are now; a change replaces the files that a DataFrame of before would read."""
        return self.read().where(F.col(self.key).isNotNull())

    def read_through(self, keys: DataFrame, load: Callable[[DataFrame], DataFrame], fresh: Column, worth: Column | None = None) -> DataFrame:
        """Rows of ``keys``: the table's where ``fresh`` holds, the others from ``load(missing keys)``, which are kept where ``worth`` holds."""
        asked = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        held = self.rows().where(fresh).join(asked, self.key, "left_semi")
        missing = asked.join(held.select(self.key), self.key, "left_anti")
        beside = f"{self.path}-changes/{uuid.uuid4().hex}"
        held.select(*self._columns()).write.parquet(f"{beside}/held")  # before the table changes under it
        load(missing).select(*self._columns()).write.parquet(f"{beside}/loaded")
        loaded = self.spark.read.schema(self.schema).parquet(f"{beside}/loaded")
        self.upsert(loaded if worth is None else loaded.where(worth))
        return self.spark.read.schema(self.schema).parquet(f"{beside}/held").unionByName(loaded)
