"""Windows that begin with a key's first event after the last one ended, in native columns: one key is many tasks.

Where the next window would begin is known for every event on its own: at the first event after its window. So times
are cut into segments that are searched apart, and the windows that do begin are those that pointer doubling reaches from a
key's first event: a round doubles how many windows are known.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in ``spark.checkpoint.dir``; a local session that has none gets one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="tessel-"))
    return df.checkpoint()


def _at(time: str = "ts_ms") -> Column:
    return F.struct(F.col(time).alias("ts_ms"), F.col("seq").alias("seq"))


def following(events: DataFrame, window_ms: int, segment_ms: int) -> DataFrame:
    """Events (key, seq, ts_ms) with ``next``: (ts_ms, seq) of the key's first event more than ``window_ms`` later, null if there is none.

    An event asks in the segment that its window ends in; if that has no event after it, the next segment with events has.
    """
    segment = lambda t: F.floor(t / segment_ms)
    asks = events.select("key", "seq", "ts_ms", segment(F.col("ts_ms") + window_ms).alias("g"), (F.col("ts_ms") + window_ms).alias("t"), F.lit(1).alias("asks"))
    has = events.select("key", "seq", "ts_ms", segment(F.col("ts_ms")).alias("g"), F.col("ts_ms").alias("t"), F.lit(0).alias("asks"))
    later = Window.partitionBy("key", "g").orderBy("t", "asks", "seq").rowsBetween(1, Window.unboundedFollowing)  # an event at that very time comes before who asks
    both = has.unionByName(asks).withColumn("here", F.first(F.when(F.col("asks") == 0, _at()), ignorenulls=True).over(later)).where("asks = 1")
    # segments of a key are few: the first event of each, and of the next one with events for any segment that is asked in
    first = has.groupBy("key", "g").agg(F.min(_at()).alias("first"))
    asked = both.where("here is null").select("key", "g").distinct().withColumn("first", F.lit(None).cast("struct<ts_ms:bigint,seq:bigint>"))
    after = Window.partitionBy("key").orderBy("g").rangeBetween(1, Window.unboundedFollowing)
    beyond = first.withColumn("first", F.struct(F.col("first.ts_ms").cast("long").alias("ts_ms"), F.col("first.seq").cast("long").alias("seq"))).unionByName(asked)
    beyond = beyond.withColumn("beyond", F.first("first", ignorenulls=True).over(after)).groupBy("key", "g").agg(F.max("beyond").alias("beyond"))
    here = F.when(F.col("here").isNotNull(), F.struct(F.col("here.ts_ms").cast("long").alias("ts_ms"), F.col("here.seq").cast("long").alias("seq"))).otherwise(F.col("beyond"))
    return both.join(beyond, ["key", "g"], "left").select("key", "seq", "ts_ms", here.alias("next"))


def starts(events: DataFrame, window_ms: int, segment_ms: int) -> DataFrame:
    """``key, seq, ts_ms`` of the events that a window begins with."""
    jump = _checkpointed(following(events, window_ms, segment_ms).where("next is not null").select("key", _at().alias("a"), F.col("next").alias("b")))
    first = events.groupBy("key").agg(F.min(F.struct(F.col("ts_ms").cast("long").alias("ts_ms"), F.col("seq").cast("long").alias("seq"))).alias("a"))
    known, n = _checkpointed(first), -1
    # jump goes 1, 2, 4, ... windows on; who is known makes as many known again
    while (now := known.count()) != n:
        n = now
        reached = known.join(jump, ["key", "a"]).select("key", F.col("b").alias("a"))
        known = _checkpointed(known.unionByName(reached).distinct())
        on = jump.select("key", F.col("a").alias("b"), F.col("b").alias("c"))
        jump = _checkpointed(jump.join(on, ["key", "b"]).select("key", "a", F.col("c").alias("b")))
    return known.select("key", "a.seq", "a.ts_ms")


def anchored(events: DataFrame, window_ms: int, segment_ms: int | None = None) -> DataFrame:
    """Events (key, seq, ts_ms) with ``start_ms``, when their window began, and ``place`` in it from 1, by (ts_ms, seq).

    ``segment_ms`` is how long a time one task sorts, 64 windows if not given. Rows without a time are left out; a null key is a
    key; (key, ts_ms, seq) are unique.
    """
    size = segment_ms or 64 * window_ms
    rows = events.where("ts_ms is not null").select("key", F.col("seq").cast("long").alias("seq"), F.col("ts_ms").cast("long").alias("ts_ms"))
    name = F.struct(F.col("key").isNull().alias("none"), F.coalesce("key", F.lit(0).cast(rows.schema["key"].dataType)).alias("key"))  # joins must find null keys
    rows = rows.withColumn("key", name)
    begun = starts(rows, window_ms, size).select("key", "seq", "ts_ms", F.lit(True).alias("begins"))
    g = F.floor(F.col("ts_ms") / size)
    both = rows.join(begun, ["key", "seq", "ts_ms"], "left").withColumn("g", g)
    upto = Window.partitionBy("key", "g").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("here", F.last(F.when(F.col("begins"), F.col("ts_ms")), ignorenulls=True).over(upto))
    before = Window.partitionBy("key").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("key", "g").agg(F.max(F.when(F.col("begins"), F.col("ts_ms"))).alias("last")).withColumn("carried", F.last("last", ignorenulls=True).over(before))
    both = both.join(carried.select("key", "g", "carried"), ["key", "g"]).withColumn("start_ms", F.coalesce("here", "carried"))
    place = F.row_number().over(Window.partitionBy("key", "start_ms").orderBy("ts_ms", "seq"))
    return both.withColumn("place", place).select(F.when(~F.col("key.none"), F.col("key.key")).alias("key"), "seq", "ts_ms", "start_ms", "place")


def rate_limited(events: DataFrame, limit: int, window_ms: int, segment_ms: int | None = None) -> DataFrame:
    """``key, seq, ts_ms, allowed``: as ``state.replay`` with a ``RateLimit``, without a Python worker."""
    return anchored(events, window_ms, segment_ms).select("key", "seq", "ts_ms", (F.col("place") <= limit).alias("allowed"))
