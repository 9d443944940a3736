"""Streams that keep the best row of each key, or the top terms, in state and emit changes.

What a key's state holds is the same whatever the order of rows and however they are split into batches, so that the last
change of each key is the row that the batch operators give.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import admitted_term
from ..operators.merge import completeness
from ..operators.rank import record_key
from ..operators.trending import MAX_ENTRIES, WINDOW_DAYS

DAY_MS = 86_400_000


class Folding(StatefulProcessor):
    """One value of state a key: ``fold(state or None, rows)`` gives the next, ``shown(state)`` what is emitted when it changes."""

    def __init__(self, state: str, fold: Callable, shown: Callable, columns: list[str], ttl_ms: int = 0):
        self.schema, self.fold, self.shown, self.columns, self.ttl_ms = state, fold, shown, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", self.schema, self.ttl_ms) if self.ttl_ms else handle.getValueState("best", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.best.get()) if self.best.exists() else None
        after = before
        for frame in rows:
            after = self.fold(after, frame.itertuples(index=False))
        if after != before:
            self.best.update(after)
            if (out := self.shown(after)) != (self.shown(before) if before is not None else None) and out is not None:
                yield pd.DataFrame([(key[0], *out)], columns=self.columns)

    def close(self) -> None:
        pass


def _none(x):
    return None if x is None or x != x else x


def _survivor(state, rows):
    """Of side 0 the last arrival, of side 1 the most complete, the earliest of these; and where the key came first."""
    a_seq, a_full, a_row, b_seq, b_full, b_row, side, seq = state or (None,) * 8
    for r in rows:
        if r.side == 0 and (a_seq is None or r.arrival_seq > a_seq):
            a_seq, a_full, a_row = int(r.arrival_seq), int(r.completeness), r.record
        if r.side == 1 and (b_seq is None or (r.completeness, -r.arrival_seq) > (b_full, -b_seq)):
            b_seq, b_full, b_row = int(r.arrival_seq), int(r.completeness), r.record
        if side is None or (r.side, r.arrival_seq) < (side, seq):
            side, seq = int(r.side), int(r.arrival_seq)
    return a_seq, a_full, a_row, b_seq, b_full, b_row, side, seq


def _survived(state):
    a_seq, a_full, a_row, b_seq, b_full, b_row, side, seq = state
    if a_seq is None or (b_seq is not None and b_full > a_full):
        return b_seq, b_full, 1, side, seq, b_row
    return a_seq, a_full, 0, side, seq, a_row


def survivors_stream(records: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """``record_key, arrival_seq, completeness, side, first_side, first_seq, record`` (JSON): changes of the survivor of each key, for update mode.

    The last change of a key is the row that ``merge.survivors`` gives for all its records. With ``ttl_ms`` keys that are not
    seen for so long are forgotten. Needs the RocksDB state store.
    """
    tags = "tags" if "tags" in records.columns else None
    rows = records.select(record_key().alias("record_key"), F.col("side").cast("int").alias("side"), F.col("arrival_seq").cast("long").alias("arrival_seq"), completeness(tags).cast("int").alias("completeness"), F.to_json(F.struct(*records.columns)).alias("record"))
    columns = ["record_key", "arrival_seq", "completeness", "side", "first_side", "first_seq", "record"]
    processor = Folding("a_seq long, a_full int, a_row string, b_seq long, b_full int, b_row string, side int, seq long", _survivor, _survived, columns, ttl_ms)
    schema = "record_key string, arrival_seq long, completeness int, side int, first_side int, first_seq long, record string"
    return rows.groupBy("record_key").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


def _latest(state, rows):
    """The newest accepted link, the first of these; and the place and type of the key's first link."""
    newest, row, at, kind = (state[:6], *state[6:7], state[7:11], state[11]) if state else ((None,) * 6, None, (None,) * 4, None)
    for r in rows:
        place = (int(r.a), int(r.b), int(r.c), int(r.link_pos))
        if at[0] is None or place < at:
            at, kind = place, r.kind
        order = (int(r.ts_ms), *(-x for x in place))
        if r.accepted and (newest[0] is None or order > tuple(newest[:5])):
            newest, row = (*order, 1), r.row
    return *newest, row, *at, kind


def latest_links_stream(links: DataFrame, accepted, ttl_ms: int = 0) -> DataFrame:
    """``url_key, link_type, a, b, c, link_pos, link`` (JSON): changes of the newest accepted link of each URL key, for update mode.

    ``links`` are as ``merge.exploded_links`` gives them; the last change of a key is the row of ``merge.latest_links``.
    """
    rows = links.select("url_key", F.col("ts_ms").cast("long").alias("ts_ms"), *[F.col(f"at.r.{c}").cast("long").alias(c) for c in "abc"], F.col("at.link_pos").alias("link_pos"), "kind", F.coalesce(accepted, F.lit(False)).alias("accepted"), F.to_json(F.struct("url", "password", "title", "event_ts", "label")).alias("row"))
    state = "ts_ms long, na long, nb long, nc long, np long, has int, row string, a long, b long, c long, link_pos long, kind string"
    shown = lambda s: None if s[5] is None else (s[11], *s[7:11], s[6])
    processor = Folding(state, _latest, shown, ["url_key", "link_type", "a", "b", "c", "link_pos", "link"], ttl_ms)
    schema = "url_key string, link_type string, a long, b long, c long, link_pos long, link string"
    return rows.groupBy("url_key").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


class Trending(StatefulProcessor):
    """The terms of a shard in a map: those of the window, and of these the best. A timer drops what leaves the window unseen."""

    def __init__(self, most: int, window_ms: int):
        self.most, self.window_ms = most, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.terms = handle.getMapState("terms", "term string", "score long, last_ms long, created_ms long")
        self.clock = handle.getValueState("clock", "now_ms long")

    def _kept(self, shard: int, found: dict, now: int) -> pd.DataFrame:
        """What retention leaves goes into the state and out."""
        alive = {t: v for t, v in found.items() if now - v[1] <= self.window_ms}
        best = sorted(alive.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[: self.most]
        for term in found.keys() - {t for t, _ in best}:
            if self.terms.containsKey((term,)):
                self.terms.removeKey((term,))
        for term, value in best:
            self.terms.updateValue((term,), value)
        for timer in [t for t in self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if best:
            self.handle.registerTimer(min(v[1] for _, v in best) + self.window_ms + 1)
        rows = [(shard, term, *value) for term, value in best] or [(shard, None, None, None, None)]
        return pd.DataFrame(rows, columns=["shard", "term", "score", "last_ms", "created_ms"]).astype({"score": "Int64", "last_ms": "Int64", "created_ms": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = {k[0]: tuple(map(int, v)) for k, v in self.terms.iterator()}
        now = int(self.clock.get()[0]) if self.clock.exists() else 0
        for frame in rows:
            for term, n, last, first in zip(frame["term"], frame["n"], frame["last_ms"], frame["first_ms"]):
                score, late, early = found.get(term, (0, last, first))
                found[term] = (score + int(n), max(late, int(last)), min(early, int(first)))
                now = max(now, int(last))
        self.clock.update((now,))
        yield self._kept(key[0], found, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = {k[0]: tuple(map(int, v)) for k, v in self.terms.iterator()}
        yield self._kept(key[0], found, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The searches of each Arrow batch added up by shard and term, so that a hot term is one row a batch."""
    for batch in batches:
        found: dict = defaultdict(lambda: [0, None, None, None])
        for shard, term, ts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            at, ms = ts.as_py(), ts.value // 1000
            x = found[shard, term]
            x[0] += 1
            x[1], x[2] = (ms, ms) if x[1] is None else (max(x[1], ms), min(x[2], ms))
            x[3] = at if x[3] is None else max(x[3], at)
        rows = [(shard, term, n, last, first, at) for (shard, term), (n, last, first, at) in found.items()]
        columns = list(zip(*rows)) or [()] * 6
        types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), batch.schema.field(2).type)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["shard", "term", "n", "last_ms", "first_ms", "ts"])


def trending_state(log: DataFrame, shards: int = 16, most: int = MAX_ENTRIES, window_days: int = WINDOW_DAYS, delay: str = "1 hour") -> DataFrame:
    """``shard, term, score, last_ms, created_ms``: the best terms of each shard after a batch, for update mode.

    Terms of a log (term, ts) are admitted as ``trending.counted`` admits them and dealt by their hash. Retention runs after
    each batch: terms not searched for ``window_days`` go, of the others the ``most`` best of a shard stay, by score, then last
    search, then name; so the state never holds more. A timer at event time empties shards nobody searches. A shard
    without terms is one row of nulls. Each batch gives whole shards, so that a sink that replaces them by number
    (``into_shards``) may write a batch twice.
    """
    term = admitted_term(F.col("term"))
    rows = log.select(term.alias("term"), F.col("ts").cast("timestamp").alias("ts")).where("term is not null and ts is not null")
    dealt = rows.select(F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), "term", "ts").mapInArrow(_combined, "shard int, term string, n long, last_ms long, first_ms long, ts timestamp")
    processor = Trending(most, window_days * DAY_MS)
    out = "shard int, term string, score long, last_ms long, created_ms long"
    return dealt.withWatermark("ts", delay).groupBy("shard").transformWithStateInPandas(processor, outputStructType=out, outputMode="Update", timeMode="EventTime")


def into_shards(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink for ``trending_state``: the shards of a batch replace those of the table; of a shard that the batch has twice (rows and a timer) the later rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)

    return write


def changes_into(store, batch_columns: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that upserts changes into a keyed store, a batch once however often it is tried."""

    def write(batch: DataFrame, number: int) -> None:
        rows = (batch.select(*batch_columns) if batch_columns else batch).persist()  # a change reads them more than once
        try:
            store.upsert(rows, name=f"batch-{number}")
        finally:
            rows.unpersist()

    return write
