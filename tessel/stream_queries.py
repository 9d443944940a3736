"""The registered queries of keyed stores and streams of changes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import metrics, trending
from .operators.store import Store
from .queries import COMPLETE, DAY, SQL, query
from .sources.adapters import attempts, duplicated_records, search_log, sql, table
from .sources.captured import shared_path
from .streaming import upserts, windows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _streamed(df: DataFrame, make, sink, batches: int) -> None:
    """Runs a stream over the rows of ``df`` in so many batches, each of as many files as keep a file no larger than a partition of ``df``."""
    spark = df.sparkSession
    at = shared_path(spark, "stream")
    files = -(-df.rdd.getNumPartitions() // batches)
    df.repartition(batches * files).write.parquet(f"{at}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")
        make(source).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    finally:
        spark.conf.set(key, before)


TERMS = "term string, score long, last_ts timestamp, created_ts timestamp"


def terms_store(spark: SparkSession, path: str, buckets: int = 16) -> Store:
    """Searched terms by term: counts add up, the last and the first search stay."""
    return Store(spark, path, TERMS, "term", (F.sum("score").alias("score"), F.max("last_ts").alias("last_ts"), F.min("created_ts").alias("created_ts")), buckets)


@query("""WITH t AS (SELECT trim(event_type || ' ' || coalesce(json_extract_string(props, '$.k'), '')) AS term, ts FROM events),
c AS (SELECT term, count(*) AS score, epoch_us(max(ts)) // 1000 AS last_ms, epoch_us(min(ts)) // 1000 AS created_ms FROM t WHERE length(term) BETWEEN 1 AND 20 GROUP BY term)
SELECT term, score, last_ms, created_ms FROM c WHERE term <> (SELECT min(term) FROM c)
UNION ALL SELECT 'migrated', 7, 0, 0 UNION ALL SELECT 'deleted', 1, 0, 0""")
def keyed_terms(spark, sf_dir):
    """Three upserts of a third of the log each, one of them tried twice; migrated terms, of which one is there already; and a deleted term."""
    store, log = terms_store(spark, shared_path(spark, "terms")), search_log(spark, sf_dir)
    for k in range(3):
        part = trending.counted(log.where(F.pmod(F.xxhash64("term", "ts"), F.lit(3)) == k))
        store.upsert(part, name=f"part-{k}")
    store.upsert(part, name="part-2")
    zero = F.lit("1970-01-01").cast("timestamp")
    moved = store.rows().agg(F.max("term").alias("term")).select("term", F.lit(99).cast("long").alias("score"), zero.alias("last_ts"), zero.alias("created_ts"))
    new = spark.createDataFrame([("migrated", 7)], "term string, score long").select("term", "score", zero.alias("last_ts"), zero.alias("created_ts"))
    store.insert_or_ignore(moved.unionByName(new))
    gone = store.delete(store.rows().agg(F.min("term").alias("term")))
    return store.rows().select("term", "score", F.unix_millis("last_ts").alias("last_ms"), F.unix_millis("created_ts").alias("created_ms")).unionByName(spark.createDataFrame([("deleted", gone, 0, 0)], "term string, score long, last_ms long, created_ms long"))


@query(sql("records") + f""", d AS (SELECT *, source || '-' || substr(md5(content), 1, 8) AS record_key, arrival_seq % 2 AS side, {COMPLETE} AS completeness FROM records),
c AS (SELECT *, row_number() OVER (PARTITION BY record_key, side ORDER BY CASE WHEN side = 0 THEN -arrival_seq END, completeness DESC, arrival_seq) AS k FROM d),
best AS (SELECT * FROM c WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY completeness DESC, side) = 1),
f AS (SELECT record_key, side AS first_side, arrival_seq AS first_seq FROM d QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY side, arrival_seq) = 1)
SELECT record_key, arrival_seq, completeness, CAST(first_side AS INTEGER) AS first_side, first_seq, title FROM best JOIN f USING (record_key)""")
def survivors_streamed(spark, sf_dir):
    """Survivors by a stream of three batches into a keyed store: the last changes are the batch's rows."""
    schema = "record_key string, arrival_seq long, completeness int, side int, first_side int, first_seq long, record string"
    store = Store(spark, shared_path(spark, "survivors"), schema, "record_key", buckets=8)
    _streamed(duplicated_records(spark, sf_dir), upserts.survivors_stream, upserts.changes_into(store), 3)
    return store.rows().select("record_key", "arrival_seq", "completeness", "first_side", "first_seq", F.get_json_object("record", "$.title").alias("title"))


@query(SQL["rate_limit_anchored"])
def rate_limit_jumps(spark, sf_dir):
    """The anchored rate limit by pointer doubling, in native columns."""
    return windows.rate_limited(attempts(spark, sf_dir), 3, DAY, DAY)


@query("SELECT o_orderpriority AS source, count(*) AS rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS failures FROM orders GROUP BY ROLLUP (o_orderpriority)")
def observed_counts(spark, sf_dir):
    """Rows and failures of each source as one pass over the orders tells them."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), "o_orderstatus")
    names = sorted(r[0] for r in orders.distinct().select("source").distinct().collect())
    watched = metrics.Watched(orders, names, F.col("o_orderstatus") == "F")
    watched.rows.write.format("noop").mode("overwrite").save()
    return watched.counts(spark)
