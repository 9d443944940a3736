"""Anchored windows by pointer doubling against the state machine."""

import random

import pytest

from tessel.streaming import state, windows


def events(seed, n, keys, span):
    rng = random.Random(seed)
    return [(rng.choice(keys), i, rng.randint(0, span), True) for i in range(n)]


SCHEMA = "key long, seq long, ts_ms long, ok boolean"


@pytest.mark.parametrize(("seed", "window", "segment"), [(1, 50, None), (2, 50, 50), (3, 7, 100), (4, 400, 90)])
def test_same_rows_as_the_replay(spark, seed, window, segment):
    rows = events(seed, 500, [1, 1, 1, 2, 3], 2000) + [(4, 1000, 5, True), (4, 1001, 5, True), (4, 1002, 5 + window, True), (4, 1003, 6 + window, True), (5, 1004, None, True)] + [(6, 2000 + k, 10**6 * k, True) for k in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in state.replay(df, state.RateLimit(3, window)).collect()}
    got = windows.rate_limited(df, 3, window, segment).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_null_keys_and_nothing(spark):
    df = spark.createDataFrame([(None, 1, 0, True), (None, 2, 1, True), (0, 3, 0, True)], SCHEMA)
    assert {(r["key"], r["seq"], r["start_ms"], r["place"]) for r in windows.anchored(df, 10).collect()} == {(None, 1, 0, 1), (None, 2, 0, 2), (0, 3, 0, 1)}
    assert windows.anchored(df.limit(0), 10).count() == 0


def test_no_python_worker(spark, capsys):
    windows.rate_limited(spark.createDataFrame(events(1, 50, [1], 100), SCHEMA), 3, 10).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan


def test_a_hot_key_is_many_tasks(spark):
    df = spark.createDataFrame([(1, k, 10 * k, True) for k in range(2000)], SCHEMA)
    found = windows.anchored(df, 35, segment_ms=500)
    assert found.select("start_ms").distinct().count() == 500 and {r["place"] for r in found.collect()} == {1, 2, 3, 4}
