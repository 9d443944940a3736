"""Keyed stores and streams of changes against their batch operators."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessel import stream_queries
from tessel.operators import merge, trending
from tessel.operators.store import Store
from tessel.streaming import upserts

TERMS = "term string, score long, last_ts timestamp, created_ts timestamp"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield


def log(spark, seed, n=200):
    rng = random.Random(seed)
    rows = [(f"t{rng.randint(0, 40)}", f"2024-01-{rng.randint(1, 28):02d} 00:00:0{rng.randint(0, 9)}") for _ in range(n)]
    return spark.createDataFrame(rows, "term string, t string").selectExpr("term", "cast(t as timestamp) ts")


def test_three_upserts_equal_one_batch(spark, tmp_path):
    counted = (F.sum("score").alias("score"), F.max("last_ts").alias("last_ts"), F.min("created_ts").alias("created_ts"))
    store = Store(spark, str(tmp_path / "terms"), TERMS, "term", counted, buckets=8)
    assert store.rows().count() == 0
    logs = [log(spark, k) for k in range(3)]
    for k, part in enumerate(logs):
        store.upsert(trending.counted(part), name=f"part-{k}")
    store.upsert(trending.counted(logs[2]), name="part-2")  # tried again
    whole = trending.counted(logs[0].unionByName(logs[1]).unionByName(logs[2]))
    assert {tuple(r) for r in store.rows().collect()} == {tuple(r) for r in whole.select("term", "score", "last_ts", "created_ts").collect()}


def test_insert_delete_and_replace(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "k string, v int", "k", buckets=4)
    frame = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    store.insert_or_ignore(frame(("a", 1), ("b", 2), (None, 3)))
    store.insert_or_ignore(frame(("a", 9), ("c", 4)))
    got = lambda: sorted(tuple(r) for r in store.rows().collect())
    assert got() == [("a", 1), ("b", 2), ("c", 4)]
    store.upsert(frame(("a", 7)))
    assert store.delete(frame(("b", 0), ("x", 0))) == 1 and store.delete(frame(("b", 0))) == 0
    assert got() == [("a", 7), ("c", 4)]
    assert store.delete(frame(("a", 0), ("c", 0))) == 2 and got() == []
    store.upsert(frame())
    store.upsert(frame(("a", 1)))
    assert got() == [("a", 1)]


def test_a_change_that_broke_off_is_done_from_what_was_written(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "k string, v long", "k", (F.sum("v").alias("v"),), buckets=2)
    frame = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v long")
    store.upsert(frame, name="one")
    import shutil

    store.upsert(frame, name="two")
    shutil.rmtree(tmp_path / "s-changes" / "two" / "applied")  # as if the driver had died before it was marked
    store.upsert(frame, name="two")
    assert sorted(tuple(r) for r in store.rows().collect()) == [("a", 2), ("b", 2)]


def test_read_through_a_time_to_live(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"), "url string, state string, at long", "url", buckets=4)
    asked = []

    def load(now):
        def run(missing):
            asked.append(sorted(r[0] for r in missing.collect()))
            return missing.select("url", F.when(F.col("url") == "empty", "").otherwise("ok").alias("state"), F.lit(now).cast("long").alias("at"))

        return run

    keys = spark.createDataFrame([("a",), ("b",), ("empty",), (None,), ("a",)], "url string")
    read = lambda now: {r["url"]: r["at"] for r in store.read_through(keys, load(now), F.lit(now) - F.col("at") <= 10, F.col("state") != "").collect()}
    assert read(0) == {"a": 0, "b": 0, "empty": 0}
    assert read(5) == {"a": 0, "b": 0, "empty": 5}
    store.upsert(spark.createDataFrame([("b", "ok", 9)], "url string, state string, at long"))
    assert read(12) == {"a": 12, "b": 9, "empty": 12}
    assert asked == [["a", "b", "empty"], ["empty"], ["a", "empty"]]


def records(n=160):
    rng = random.Random(8)
    out = []
    for seq in range(n):
        links = [(rng.choice(["quark", ""]), f"https://pan.quark.cn/s/{rng.randint(0, 30)}", None)] * rng.randint(0, 2)
        out.append((seq, rng.randint(0, 1), "", f"s-{rng.randint(0, 25)}", rng.choice(["", "c"]), "t" * rng.randint(0, 35), rng.choice(["", "x"]), links, f"2024-01-{rng.randint(1, 28):02d} 00:00:00" if rng.random() < 0.8 else None))
    return out


RECORD = "arrival_seq long, side int, message_id string, unique_id string, channel string, title string, content string, links array<struct<type:string,url:string,password:string>>, t string"


def streamed(spark, tmp_path, df, make, store, pieces, seed):
    """Runs a stream over the rows of ``df`` in files of random size and order, a file a batch."""
    rows = df.collect()
    random.Random(seed).shuffle(rows)
    cuts = sorted(random.Random(seed).sample(range(1, len(rows)), pieces - 1))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).foreachBatch(upserts.changes_into(store)).start()
    q.awaitTermination()


@pytest.mark.parametrize("pieces", [1, 4])
def test_survivors_of_any_split_are_those_of_the_batch(spark, tmp_path, pieces):
    df = spark.createDataFrame(records(), RECORD)
    store = Store(spark, str(tmp_path / "s"), "record_key string, arrival_seq long, completeness int, side int, first_side int, first_seq long, record string", "record_key", buckets=2)
    streamed(spark, tmp_path, df, upserts.survivors_stream, store, pieces, pieces)
    columns = ["record_key", "arrival_seq", "completeness", "first_side", "first_seq"]
    got = store.rows().select(*columns, F.get_json_object("record", "$.title").alias("title")).collect()
    want = merge.survivors(df).select(*columns, "title").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want} and len(got) == len(want) > 10


def test_latest_links_of_any_split_are_those_of_the_batch(spark, tmp_path):
    df = spark.createDataFrame(records(120), RECORD).withColumn("event_ts", F.col("t").cast("timestamp")).withColumns({"total": (F.col("arrival_seq") % 7).cast("int"), "label": F.lit("plugin:s"), "skip_filter": F.lit(False)})
    df = df.withColumn("ts_ms", F.coalesce(F.unix_millis("event_ts"), F.lit(0)))
    links = merge.exploded_links(df)
    accepted = F.length("title") % 3 != 0
    store = Store(spark, str(tmp_path / "s"), "url_key string, link_type string, a long, b long, c long, link_pos int, link string", "url_key", buckets=2)
    streamed(spark, tmp_path, links, lambda s: upserts.latest_links_stream(s, accepted), store, 3, 5)
    got = {(r["url_key"], r["link_type"], r["a"], r["b"], r["c"], r["title"]) for r in store.rows().withColumn("title", F.get_json_object("link", "$.title")).collect()}
    want = {(r["url_key"], r["link_type"], *r["at"]["r"], r["title"]) for r in merge.latest_links(links, accepted).collect()}
    assert got == want and len(got) > 10


def test_trending_state_is_bounded_and_follows_the_rules(spark, tmp_path):
    days = [(d, [(f"n{d}-{k}", 1) for k in range(4000)] + [(f"hot{k}", 3 + k) for k in range(5)] + ([("early", 50)] if d == 1 else [])) for d in (1, 3, 5, 12)]
    for d, counts in days:
        rows = [(t, f"2024-01-{d:02d} 00:00:00") for t, n in counts for _ in range(n)]
        spark.createDataFrame(rows, "term string, t string").selectExpr("term", "cast(t as timestamp) ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    source = spark.readStream.schema("term string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []

    def sink(batch, number):
        upserts.into_shards(str(tmp_path / "out"))(batch, number)
        upserts.into_shards(str(tmp_path / "out"))(batch, number)  # tried again
        seen.append(spark.read.parquet(str(tmp_path / "out")).where("term is not null").groupBy("shard").count().agg(F.max("count")).first()[0])

    q = upserts.trending_state(source, shards=3, most=30).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    assert len(seen) >= 4 and max(seen) <= 30
    entries = [m["numRowsTotal"] for p in q.recentProgress for m in p["stateOperators"]]
    assert max(entries) <= 3 * 2 * (30 + 2)  # terms, clocks and timers of the shards and their indexes, not the 16,000 terms
    got = {r["term"]: r["score"] for r in spark.read.parquet(str(tmp_path / "out")).where("term is not null").collect()}
    assert {t: got.get(t) for t in (*(f"hot{k}" for k in range(5)), "early")} == {**{f"hot{k}": 4 * (3 + k) for k in range(5)}, "early": None}
    assert all(t.startswith(("hot", "n12-", "n5-")) for t in got)


def test_batches_are_dealt_to_files_that_follow_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "shared_path", lambda spark, name: str(tmp_path / name))
    seen = []
    stream_queries._streamed(spark.range(0, 1000, 1, 8), lambda source: source, lambda batch, number: seen.append(batch.count()), 3)
    files = list(tmp_path.glob("stream/in/*.parquet"))
    assert len(seen) == 3 and sum(seen) == 1000
    assert len(files) == 9 and max(len(pd.read_parquet(f)) for f in files) < 200


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    small = {key: "32k", "spark.sql.files.maxPartitionBytes": "32k", "spark.sql.files.openCostInBytes": "1k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        store = Store(spark, str(tmp_path / "s"), "k string, v string", "k", buckets=2)
        frame = spark.range(0, 8000, 1, 8).select(F.col("id").cast("string").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
        store.upsert(frame)
        store.upsert(frame.where("k < '5'").withColumn("v", F.lit("new")))
        got = {r["k"]: r["v"] for r in store.rows().collect()}
    finally:
        for k in small:
            spark.conf.unset(k)
    assert got == {r["k"]: "new" if r["k"] < "5" else r["v"] for r in frame.collect()}
    assert all(len(list((tmp_path / "s").glob(f"bucket={b}/*.parquet"))) > 1 for b in range(2))
