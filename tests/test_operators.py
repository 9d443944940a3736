import random

import pytest
from pyspark.sql import functions as F

from tessel.operators import charts, filters, merge, rank, trending
from tessel.plans.search import Request
from tessel.sources.adapters import AS_OF
from tessel.streaming import state


def test_recency_buckets(spark):
    ts = ["2024-02-05 00:00:00", "2024-01-30 00:00:00", "2024-01-28 00:00:00", "2024-01-24 00:00:00", "2024-01-01 00:00:00", "2023-11-02 00:00:00", "2023-01-31 00:00:00", "2020-01-01 00:00:00", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, t string").orderBy("i").select(rank.recency_score(F.col("t").cast("timestamp"), AS_OF)).collect()
    assert [r[0] for r in rows] == [500, 500, 400, 300, 200, 100, 50, 20, 0]


def test_positions_are_a_total_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 3), rng.randint(0, 99), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, a int, b int, i int")
    got = {r["i"]: r["rank"] for r in rank.positions(df, [F.col("a")], [F.col("b"), F.col("i")], within=("g",)).collect()}
    for g in "ab":
        order = sorted((a, b, i) for h, a, b, i in rows if h == g)
        assert {i: k + 1 for k, (_, _, i) in enumerate(order)} == {i: got[i] for _, _, i in order}


RECORD = "side int, arrival_seq long, unique_id string, message_id string, channel string, title string, content string, links array<struct<type:string,url:string,password:string>>"


def test_survivors(spark):
    link = [("", "u", "")]
    rows = [
        (0, 1, "k", "", "", "t", "", None), (0, 2, "k", "", "", "u", "", None), (1, 3, "k", "", "", "v", "", None), (1, 4, "k", "", "", "w", "c", link), (1, 5, "k", "", "", "x", "c", link),
        (1, 6, "", "m", "", "t", "", None), (1, 7, None, None, "c", "t", "", []), (0, 8, None, "", "c", "t", "", []),
    ]
    got = {r["record_key"]: (r["arrival_seq"], r["first_side"], r["first_seq"]) for r in merge.survivors(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {"k": (4, 0, 1), "m": (6, 1, 6), "title_t_c": (8, 0, 8)}


def test_survivors_do_not_change_survivors(spark):
    rows = [(i % 2, i, f"k{i % 7}", "", "", "t" * i, "c" if i % 3 else "", [("", "u", "")] * (i % 4)) for i in range(60)]
    once = merge.survivors(spark.createDataFrame(rows, RECORD)).select(*[c.split()[0] for c in RECORD.replace(", ", "\n").split("\n") if c.split()[0] in ("side", "arrival_seq", "unique_id", "message_id", "channel", "title", "content", "links")])
    twice = merge.survivors(once)
    assert sorted(r["arrival_seq"] for r in once.collect()) == sorted(r["arrival_seq"] for r in twice.collect())


def test_union_merge_keeps_left_and_first_new(spark):
    left = spark.createDataFrame([("a", "u", 1), ("a", "u", 2)], "link_type string, url string, pos int")
    right = spark.createDataFrame([("a", "u", 1), ("a", "v", 2), ("a", "v", 3), ("b", "u", 4)], "link_type string, url string, pos int")
    assert sorted((r["link_type"], r["url"], r["pos"], r["batch"]) for r in merge.union_merge(left, right).collect()) == [("a", "u", 1, 0), ("a", "u", 2, 0), ("a", "v", 2, 1), ("b", "u", 4, 1)]


def test_records_without_dead(spark):
    rows = [(1, [("", "x", ""), ("", "y", "")]), (2, [("", "x", "")]), (3, [])]
    recs = spark.createDataFrame(rows, "arrival_seq long, links array<struct<type:string,url:string,password:string>>")
    got = merge.records_without_dead(recs, spark.createDataFrame([("x",), ("x",)], "url string")).collect()
    assert sorted((r["arrival_seq"], [l["url"] for l in r["links"]]) for r in got) == [(1, ["y"]), (3, [])]


def test_trending_counts_caps_and_decays(spark):
    log = [("old", "2024-01-01 00:00:00")] + [(f"t{i}", "2024-01-30 00:00:00") for i in range(60)] + [("t7", "2024-01-31 00:00:00")] * 2
    terms = trending.counted(spark.createDataFrame(log, "term string, ts string").withColumn("ts", F.col("ts").cast("timestamp")))
    top = trending.trending(terms, AS_OF).orderBy("rank").collect()
    assert len(top) == 30 and (top[0]["term"], top[0]["score"], top[0]["heat"]) == ("t7", 3, 100)
    assert trending.retained(terms, AS_OF).count() == 30 and terms.where("term = 'old'").count() == 1


def test_pages_and_requests(spark):
    items = spark.range(45).select(F.lit("c").alias("category"), F.col("id").alias("pos"))
    assert [r["rank"] for r in charts.page_of(items, "category", 3).orderBy("rank").collect()] == [41, 42, 43, 44, 45]
    for bad in (dict(keyword=""), dict(keyword="x" * 201), dict(keyword="x", limit=0), dict(keyword="x", page=0)):
        with pytest.raises(ValueError):
            Request(**bad)
    assert [Request("x", shape=s).shape for s in ("", "merge", "merged_by_type", "results", "all", "odd")] == ["merged", "merged", "merged", "results", "all", "all"]


MACHINES = [state.RateLimit(3, 50), state.Lockout(2, 40), state.Breaker(2, 40)]


def events(seed=3, n=300):
    rng = random.Random(seed)
    return [(rng.randint(0, 4), i, rng.randint(0, 1000), rng.random() < 0.5) for i in range(n)]


def by_hand(machine, rows):
    states, out = {}, set()
    for key, seq, ts, ok in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        states[key], passed = machine.step(states.get(key, machine.start), ts, ok)
        out.add((key, seq, ts, passed))
    return out


@pytest.mark.parametrize("machine", MACHINES, ids=lambda m: type(m).__name__)
def test_replay_is_the_step_in_order(spark, machine):
    rows = events()
    got = state.replay(spark.createDataFrame(rows, "key long, seq long, ts_ms long, ok boolean"), machine).collect()
    assert {tuple(r) for r in got} == by_hand(machine, rows) and len(got) == len(rows)


def test_rate_limit_opens_a_window_after_the_last_one():
    m, s, out = state.RateLimit(2, 10), state.RateLimit(2, 10).start, []
    for ts in (0, 1, 2, 10, 11, 12):
        s, passed = m.step(s, ts, True)
        out.append(passed)
    assert out == [True, True, False, False, True, True]


def test_stream_equals_replay(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, machine = sorted(events(n=80), key=lambda r: r[2]), MACHINES[0]
    schema = "key long, seq long, ts_ms long, ok boolean"
    for k in range(2):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.stream(source, machine).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == by_hand(machine, rows)


def test_cache_replay():
    log = [(1, 0, "set", "a", 100, 1), (2, 1, "set", "b", 100, 1), (3, 2, "get", "a", 0, 0), (4, 3, "set", "c", 100, 1), (5, 4, "get", "b", 0, 0), (6, 5, "get", "a", 0, 0), (7, 200, "get", "a", 0, 0)]
    assert state.replay_cache(log, 2, 50) == [(3, "a", True), (5, "b", False), (6, "a", True), (7, "a", False)]
    assert state.replay_cache([(1, 0, "set", "a", 9, 40), (2, 0, "set", "b", 9, 20), (3, 1, "get", "a", 0, 0)], 9, 50) == [(3, "a", False)]


def by_scan(log, capacity, most):
    held, out = {}, []  # in order of use
    for seq, ts, op, key, ttl, size in log:
        if op == "get":
            hit = key in held and held[key][0] > ts
            entry = held.pop(key, None)
            if hit:
                held[key] = entry
            out.append((seq, key, hit))
            continue
        held.pop(key, None)
        if op == "set":
            held = {k: x for k, x in held.items() if x[0] > ts}
            while held and (len(held) >= capacity or sum(x[1] for x in held.values()) + size > most):
                held.pop(next(iter(held)))
            held[key] = (ts + ttl, size)
    return out


def test_caches_by_namespace(spark):
    rng = random.Random(3)
    logs = {n: sorted((rng.randint(0, 400), i, rng.choice(["get", "get", "set", "delete"]), rng.choice("abcdefgh"), rng.choice([5, 50, 500]), rng.randint(1, 9)) for i in range(300)) for n in ("x", "y")}
    rows = [(n, i, ts, op, key, ttl, size) for n, log in logs.items() for ts, i, op, key, ttl, size in log]
    df = spark.createDataFrame(rows, "namespace string, seq long, ts_ms long, op string, key string, ttl_ms long, size int")
    got = sorted((r["namespace"], r["seq"], r["key"], r["hit"]) for r in state.cache_hits(df, 4, 18).collect())
    assert got == sorted((n, *x) for n, log in logs.items() for x in by_scan([(i, ts, op, key, ttl, size) for ts, i, op, key, ttl, size in log], 4, 18))


def test_merged_stream_and_running_terms(spark, tmp_path):
    rows = [("quark", "u", "2024-01-01 00:00:00"), ("quark", "u", "2024-01-01 00:01:00"), ("115", "u", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "link_type string, url string, t string").selectExpr("link_type", "url", "cast(t as timestamp) event_ts").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("link_type string, url string, event_ts timestamp").parquet(str(tmp_path / "in"))
    q = state.merged_stream(source).writeStream.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).foreachBatch(state.into_table(str(tmp_path / "out"), lambda b: b)).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_trending_stream_with_retention(spark, tmp_path):
    rows = [(f"t{i % 40}", "2024-01-30 00:00:00") for i in range(100)] + [("old", "2024-01-01 00:00:00")] * 9
    spark.createDataFrame(rows, "term string, t string").selectExpr("term", "cast(t as timestamp) ts").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("term string, ts timestamp").parquet(str(tmp_path / "in"))
    q = state.trending_stream(source).writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).foreachBatch(state.retained_terms(str(tmp_path / "out"), AS_OF)).start()
    q.awaitTermination()
    got = {r["term"]: r["score"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 30 and "old" not in got and all(got.get(f"t{i}") == 3 for i in range(20))


def test_first_of_each_and_latest_run(spark):
    rows = [(1, "d", "l", "n", "k"), (2, "d", "m", "o", "k"), (3, "", "l", "n", "k"), (4, None, "l", "n", "z"), (5, None, "", None, "k"), (6, None, None, "", "k")]
    df = spark.createDataFrame(rows, "arrival_seq long, disk_id string, link string, name string, kind string")
    assert sorted(r["arrival_seq"] for r in merge.first_of_each(df).collect()) == [1, 3, 5]
    runs = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], "request string, run_id int, n int")
    assert sorted(r["n"] for r in merge.of_latest_run(runs).collect()) == [2, 3]


def test_settings(spark):
    known = spark.createDataFrame([("a",), ("B",), ("c",)], "name string")
    assert sorted(r["name"] for r in filters.enabled_sources(known, spark.createDataFrame([("A",), ("x",)], "name string"), spark.createDataFrame([("b",)], "name string")).collect()) == ["B", "a"]
    assert [r["name"] for r in filters.expand_new(known, known.where("name <> 'c'")).collect()] == ["c"]
    assert [filters.clamped(x, 1, 16, 4) for x in (None, 0, 7, 99)] == [4, 1, 7, 16]


def test_cache_stats_and_limits(spark):
    hits = spark.createDataFrame([("n", i, "k", i % 4 == 0) for i in range(8)], "namespace string, seq int, key string, hit boolean")
    assert tuple(state.cache_stats(hits).select("gets", "hits", "misses", "hit_percent").first()) == (8, 2, 6, 25.0)
    assert [state.limit_of(p, {"/a": 10, "/a/b": 30}, 60) for p in ("/a", "/a/b/c", "/a?x", "/z")] == [10, 30, 10, 60]
