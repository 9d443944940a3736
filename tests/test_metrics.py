"""Metrics that are observed while plans run."""

import time

from pyspark.sql import functions as F

from tessel.operators import metrics


def rows(spark):
    return spark.createDataFrame([("A", None), ("a", "bad"), ("b", None), ("x", "bad"), (None, None)], "source string, error string")


def test_counts_of_a_query(spark):
    watched = metrics.Watched(rows(spark), ["a", "B", "c"], F.col("error").isNotNull())
    assert watched.rows.where("error is null").count() == 3
    assert {tuple(r) for r in watched.counts(spark).collect()} == {(None, 5, 2), ("a", 2, 1), ("B", 1, 0), ("c", 0, 0)}
    assert {tuple(r) for r in watched.warnings(spark).collect()} == {("a", "1 of 2 failed"), ("c", "no answer")}


def test_counts_of_a_stream(spark, tmp_path):
    for _ in range(3):
        rows(spark).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = metrics.Listener("sources", ["a", "c"])
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema("source string, error string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        watched = metrics.watched_stream(source, "sources", ["a", "c"], F.col("error").isNotNull())
        watched.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if listener.total[None][0] == 15:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert {k: tuple(v) for k, v in listener.total.items()} == {None: (15, 6), "a": (6, 3), "c": (0, 0)} and listener.batches >= 3 and listener.took_ms > 0
