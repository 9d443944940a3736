"""Per-key state machines. One pure step serves the batch replay, the stream and the tests."""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.trending import retained

State = tuple[int, int]


@dataclass(frozen=True)
class RateLimit:
    """A window that begins with a key's first event after the last one ended; ``limit`` events pass in each."""

    limit: int
    window_ms: int
    start: State = (0, -1)

    def step(self, state: State, ts_ms: int, ok: bool) -> tuple[State, bool]:
        count, until = state
        if until < 0 or ts_ms > until:
            return (1, ts_ms + self.window_ms), self.limit >= 1
        return (count + 1, until), count + 1 <= self.limit


@dataclass(frozen=True)
class Lockout:
    """After ``failures`` in a row a key is locked for ``lock_ms``; a success or the end of the lock clears it. False: blocked."""

    failures: int = 5
    lock_ms: int = 300_000
    start: State = (0, -1)

    def step(self, state: State, ts_ms: int, ok: bool) -> tuple[State, bool]:
        count, until = state
        if until >= 0 and ts_ms < until:
            return state, False
        if until >= 0:
            count = 0
        if ok:
            return (0, -1), True
        return (count + 1, ts_ms + self.lock_ms if count + 1 >= self.failures else -1), True


@dataclass(frozen=True)
class Breaker:
    """Open ``cooldown_ms`` after the last of ``failures`` failures; a later check closes it, and so does a success then. False: open."""

    failures: int = 5
    cooldown_ms: int = 300_000
    start: State = (0, -1)

    def step(self, state: State, ts_ms: int, ok: bool) -> tuple[State, bool]:
        count, last = state
        healthy = True
        if count >= self.failures:
            if ts_ms - last >= self.cooldown_ms:
                count = 0
            else:
                healthy = False
        if ok:
            return (count if not healthy else 0, last), healthy
        return (count + 1, ts_ms), healthy


def replay(events: DataFrame, machine) -> DataFrame:
    """``key, seq, ts_ms, allowed``: the machine over the events (key, seq, ts_ms, ok) of each key in order of (ts_ms, seq).

    Rows are sorted by key inside partitions and streamed, so that a key of any size needs the memory of one state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), machine.start
        for batch in batches:
            allowed = []
            for key, ts, ok in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                if key != last:
                    last, state = key, machine.start
                state, passed = machine.step(state, ts, bool(ok))
                allowed.append(passed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(allowed, pa.bool_())], names=["key", "seq", "ts_ms", "allowed"])

    rows = events.select("key", "seq", "ts_ms", "ok").where("ts_ms is not null")
    return rows.repartition("key").sortWithinPartitions("key", "ts_ms", "seq").mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, seq long, ts_ms long, allowed boolean")


def _processor(machine) -> StatefulProcessor:
    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("machine", "a long, b long")

        def handleInputRows(self, key, rows, timerValues):
            state = tuple(self.state.get()) if self.state.exists() else machine.start
            out = []
            for frame in rows:
                for seq, ts, ok in sorted(zip(frame["seq"], frame["ts_ms"], frame["ok"]), key=lambda r: (r[1], r[0])):
                    state, passed = machine.step(tuple(map(int, state)), int(ts), bool(ok))
                    out.append((key[0], int(seq), int(ts), passed))
            self.state.update(state)
            yield pd.DataFrame(out, columns=["key", "seq", "ts_ms", "allowed"])

        def close(self) -> None:
            pass

    return Processor()


def stream(events: DataFrame, machine) -> DataFrame:
    """As ``replay`` on a stream; batches must come in order of time. Needs the RocksDB state store."""
    kind = events.schema["key"].dataType.simpleString()
    return events.groupBy("key").transformWithStateInPandas(_processor(machine), outputStructType=f"key {kind}, seq long, ts_ms long, allowed boolean", outputMode="Append", timeMode="None")


class Cache:
    """A cache with time-to-live and least-recently-used eviction, bounded by entries and bytes; expired entries go when one is set."""

    def __init__(self, capacity: int, most_bytes: int):
        self.capacity, self.most_bytes, self.total = capacity, most_bytes, 0
        self.held: OrderedDict[str, tuple[int, int]] = OrderedDict()
        self.ends: list[tuple[int, str]] = []  # a heap; entries that are gone or were set anew stay in it

    def drop(self, key: str) -> None:
        if key in self.held:
            self.total -= self.held.pop(key)[1]

    def get(self, ts: int, key: str) -> bool:
        hit = key in self.held and self.held[key][0] > ts
        if hit:
            self.held.move_to_end(key)
        else:
            self.drop(key)
        return hit

    def set(self, ts: int, key: str, ttl: int, size: int) -> None:
        self.drop(key)
        while self.ends and self.ends[0][0] <= ts:
            until, old = heapq.heappop(self.ends)
            if old in self.held and self.held[old][0] == until:
                self.drop(old)
        while self.held and (len(self.held) >= self.capacity or self.total + size > self.most_bytes):
            self.total -= self.held.popitem(last=False)[1][1]
        self.held[key] = (ts + ttl, size)
        self.total += size
        heapq.heappush(self.ends, (ts + ttl, key))
        if len(self.ends) > 2 * len(self.held) + 1000:
            self.ends = [(until, k) for k, (until, _) in self.held.items()]
            heapq.heapify(self.ends)

    def step(self, ts: int, op: str, key: str, ttl: int, size: int) -> bool | None:
        """Whether a get hits; None for other operations."""
        if op == "get":
            return self.get(ts, key)
        self.drop(key) if op == "delete" else self.set(ts, key, ttl, size)
        return None


def replay_cache(log: list[tuple], capacity: int, most_bytes: int) -> list[tuple[int, str, bool]]:
    """A cache over (seq, ts_ms, op, key, ttl_ms, size): (seq, key, hit) of each get."""
    cache = Cache(capacity, most_bytes)
    found = [(seq, key, cache.step(ts, op, key, ttl, size)) for seq, ts, op, key, ttl, size in log]
    return [x for x in found if x[2] is not None]


def cache_hits(log: DataFrame, capacity: int = 1000, most_bytes: int = 100 << 20) -> DataFrame:
    """``namespace, seq, key, hit`` of each get. A namespace is one cache; its operations are sorted and streamed, so that it needs the memory of its entries, however long its log."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cache = object(), None
        for batch in batches:
            out = []
            for namespace, seq, ts, op, key, ttl, size in zip(*(c.to_pylist() for c in batch.columns)):
                if namespace != last:
                    last, cache = namespace, Cache(capacity, most_bytes)
                hit = cache.step(ts, op, key, ttl or 0, size or 0)
                if hit is not None:
                    out.append((namespace, seq, key, hit))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=["namespace", "seq", "key", "hit"])

    rows = log.select("namespace", F.col("seq").cast("long"), F.col("ts_ms").cast("long"), "op", "key", F.col("ttl_ms").cast("long"), F.col("size").cast("long")).where("ts_ms is not null")
    return rows.repartition("namespace").sortWithinPartitions("namespace", "ts_ms", "seq").mapInArrow(run, "namespace string, seq long, key string, hit boolean")


def merged_stream(batches: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of links without repeats of (link_type, url); the watermark bounds the state."""
    return batches.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["link_type", "url"])


def trending_stream(log: DataFrame) -> DataFrame:
    """A stream of (term, ts) as running counts, for update mode."""
    return log.groupBy("term").agg(F.count(F.lit(1)).alias("score"), F.max("ts").alias("last_ts"), F.min("ts").alias("created_ts"))


def retained_terms(path: str, as_of: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink for ``trending_stream`` in complete mode: after each batch the table holds what retention leaves."""

    def write(batch: DataFrame, number: int) -> None:
        retained(batch, as_of).write.mode("overwrite").parquet(path)

    return write


def into_table(path: str, shape: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: each batch's shape replaces the table of its number."""

    def write(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def cache_stats(hits: DataFrame) -> DataFrame:
    """``namespace, gets, hits, misses, hit_percent`` of what ``cache_hits`` found."""
    g = hits.groupBy("namespace").agg(F.count(F.lit(1)).alias("gets"), F.count_if("hit").alias("hits"))
    return g.withColumns({"misses": F.col("gets") - F.col("hits"), "hit_percent": F.round(100 * F.col("hits") / F.col("gets"), 2)})


def limit_of(path: str, limits: dict[str, int], default: int) -> int:
    """The limit of a path: its own, else that of the longest listed path it begins with, else the default."""
    return limits.get(path) or next((limits[p] for p in sorted(limits, key=len, reverse=True) if path.startswith(p)), default)
