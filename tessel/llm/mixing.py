"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in the order of their hashes, form blocks. Block i of a source with weight w is released at slot
floor(i / w) and due by slot ceil((i + 1) / w); the earliest deadline goes first among the released. Weights are exact
fractions, whole parts of a period that is the least common multiple of their denominators. The schedule repeats after
it, so the driver plans one period and the plan is broadcast; of a period beyond LONGEST_PERIOD it plans the blocks that
there are instead. After any slot t a source that still has blocks has had between t*w - 1 and t*w + 1 of them.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, n_partitions, stored

#: Rows of a block; slots of a period that is planned as a whole, at most.
BLOCK_ROWS, LONGEST_PERIOD = 64, 65_536
#: Rows of a source that are ranked in one window, on average; keys that rows are ranked by; rows of one id that are dealt out at once; sources at most.
BUCKET_ROWS, KEYS, REPEATS, MOST_SOURCES = 4_000, 1 << 60, 65_536, 100_000


def exactly(weights: dict) -> dict:
    """Weights as fractions of their sum; decimals count as they are written."""
    found = {s: Fraction(str(w)) for s, w in weights.items()}
    total = sum(found.values())
    return {s: w / total for s, w in found.items()}


def shares(weights: dict, period: int) -> dict:
    """Weights as whole numbers, one at least each, that sum to the period: exact if it is a multiple of their denominators, else largest remainders first, ties by order."""
    exact = {s: w * period for s, w in exactly(weights).items()}
    if any(x.denominator > 1 for x in exact.values()):
        exact = {s: 1 + x * (period - len(weights)) / period for s, x in exact.items()}
    out = {s: math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: -(exact[s] - out[s]))[: period - sum(out.values())]:
        out[s] += 1
    return out


def schedule(parts: dict, period: int, blocks: dict | None = None) -> list[tuple]:
    """One period, or so many ``blocks`` of each source, by earliest deadline first: (source, k, slot, release, deadline) of each source's k-th block."""
    most = parts if blocks is None else blocks
    waiting = [(0, -(-period // n), at, s, 0) for at, (s, n) in enumerate(parts.items()) if most[s]]  # by release
    heapq.heapify(waiting)
    ready, out, slot = [], [], 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, due, at, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, at, s, k, release))
        due, at, s, k, release = heapq.heappop(ready)
        out.append((s, k, slot, release, due))
        slot += 1
        if (k := k + 1) < most[s]:
            n = parts[s]
            heapq.heappush(waiting, (k * period // n, -(-(k + 1) * period // n), at, s, k))
    return out


def planned(goal: dict, blocks: dict | None = None) -> tuple[int, dict, list[tuple]]:
    """(period, blocks of each source in it, its plan) for target weights; the plan of a period beyond LONGEST_PERIOD is that of so many ``blocks``, and does not repeat."""
    period = math.lcm(*(w.denominator for w in exactly(goal).values())) if goal else 1
    parts = shares(goal, period) if goal else {}
    again = blocks is None or period <= LONGEST_PERIOD
    return period, parts if again else blocks, schedule(parts, period, None if again else blocks)


def mix(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, source, block, slot, place, release, deadline``: one row for each row of ``docs``.

    Rows in the order of (slot, place) are the mixture. ``weights`` maps sources to positive targets; None gives all the
    same, and a source without one gets the smallest. Targets are exact fractions of their sum. Nothing is dropped: after
    a source has run out its slots stay empty and the others go on in their proportions. A null source is a source of its
    own; null ids come first in their source. Rows that repeat an id follow each other, in no particular order; they are
    counted before the shuffle and dealt out again after it, so that one id may have any number of rows. Texts are not
    read; extra columns are ignored, whatever their names; an empty table gives an empty result. The driver sees one row
    for each source (MOST_SOURCES at most, else an error) and plans one for each slot of a period, or for each block.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    each = stored(rows.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n")), "ids")
    seen = each.groupBy("source").agg(F.sum("n").alias("n"), F.max("n").alias("most")).limit(MOST_SOURCES + 1).collect()
    if len(seen) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    counts = {r["source"]: r["n"] for r in seen}
    least = min(weights.values()) if weights else 1
    goal = {s: (weights or {}).get(s, least) for s in sorted(counts, key=lambda s: (s is not None, s))}
    period, turns, plan = planned(goal, {s: -(-n // block_rows) for s, n in counts.items()})
    table = spark.createDataFrame(plan, "source string, k long, first long, released long, due long")
    sizes = [(s, turns[s], -(-KEYS // -(-n // BUCKET_ROWS))) for s, n in counts.items()]
    sizes = spark.createDataFrame(sizes, "s_source string, parts long, span long")
    keyed = each.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")).otherwise(-1))
    keyed = keyed.join(F.broadcast(sizes), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    keyed = keyed.withColumn("bucket", F.expr("greatest(key, 0) div span"))  # buckets are runs of keys, so that their number changes no order
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("source", "bucket").agg(F.sum("n").alias("total")).withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("nth", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    ranked = ranked.alias("r").join(offsets.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.bucket") == F.col("o.bucket")))
    ranked = ranked.select("doc_id", F.col("r.source").alias("source"), "parts", "n", (F.col("before") + F.col("nth")).alias("at"))
    dealt = ranked.withColumn("c", F.explode(F.expr(f"sequence(0L, (n - 1) div {REPEATS})")))
    if max((r["most"] for r in seen), default=0) > REPEATS:
        dealt = dealt.repartition(n_partitions(spark))
    dealt = dealt.withColumn("at", F.explode(F.expr(f"sequence(at + c * {REPEATS}, at + least(n, (c + 1) * {REPEATS}) - 1)")))
    dealt = dealt.withColumns({"block": F.expr(f"at div {block_rows}"), "place": (F.col("at") % block_rows).cast("int")})
    dealt = dealt.select("doc_id", "source", "block", "place", F.expr("block div parts").alias("turn"), (F.col("block") % F.col("parts")).alias("k"))
    # one row for each slot of a period, or for each block
    out = dealt.alias("r").join((F.broadcast(table) if len(plan) <= BROADCAST_ROWS else table).alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.k") == F.col("t.k")))
    since = F.col("turn") * period
    return out.select("doc_id", F.col("r.source").alias("source"), "block", (since + F.col("first")).alias("slot"), "place", (since + F.col("released")).alias("release"), (since + F.col("due")).alias("deadline"))


def sql(weights: dict, block_rows: int = BLOCK_ROWS) -> str:
    """The mixture of a table that has just the sources of ``weights``."""
    period, turns, plan = planned({s: weights[s] for s in sorted(weights)})
    rows = ", ".join(f"('{s}', {turns[s]}, {k}, {first}, {released}, {due})" for s, k, first, released, due in plan)
    return f"""
WITH p(source, parts, k, first, released, due) AS (VALUES {rows}),
n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) NULLS FIRST, doc_id) - 1 AS nth FROM documents),
b AS (SELECT doc_id, source, nth // {block_rows} AS block, CAST(nth % {block_rows} AS INTEGER) AS place FROM n)
SELECT doc_id, source, block, block // parts * {period} + first AS slot, place, block // parts * {period} + released AS release, block // parts * {period} + due AS deadline
FROM b JOIN p USING (source) WHERE block % parts = k
"""
