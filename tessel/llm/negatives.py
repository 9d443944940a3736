"""Hard-negative mining by bit-sliced integer products.

Vectors become integers, and the rows of a tile are cut into the bit-planes of their two's complement. The products of
a block of anchors with the planes are summed from the most significant plane down; after each, what the planes below
can still add lies between the sums of the anchor's negative and positive components, so that every pair has a score
interval, half as wide as before. A pair is dropped as soon as its interval can't reach the best found so far or none
of the windows asked for; pairs that outlive the last plane have their exact score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, stored

#: Components are clamped to this many either way, so that sums over 2**16 of them stay in a long.
MOST = 1 << 23
#: Bytes of a block of anchors (components of four bytes), rows a part of the rows has at least, rows and anchors of a tile.
ANCHOR_BYTES, PART_ROWS, TILE_ROWS, TILE_ANCHORS = 64 << 20, 1 << 13, 2048, 512
#: Share of a tile's pairs below which planes are multiplied pair by pair.
SPARSE = 0.02
NONE = np.iinfo(np.int64).min + 1


class Planes:
    """Bit-planes of a tile of integer rows, most significant first, each with its weight and the most that those below it can make."""

    def __init__(self, x: np.ndarray, kind: type):
        bits = int(max(x.max(initial=0), -1 - x.min(initial=0))).bit_length() + 1
        self.n = len(x)
        self.each = [((-1 if k == bits - 1 else 1) << k, (1 << k) - 1, (x >> k & 1).astype(kind)) for k in range(bits - 1, -1, -1)]


def _kind(anchors: np.ndarray, rows: np.ndarray) -> type:
    """The smallest type in which every sum is exact."""
    most = float(np.abs(anchors).sum(axis=1).max(initial=0)) * 2 * max(1, np.abs(rows).max(initial=0))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def sift(anchors: np.ndarray, rows: np.ndarray, alive: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs of ``alive`` that ``keep(low, high, alive, at)`` never drops; ``at`` takes values of the anchors to the pairs."""
    kind = _kind(anchors, rows)
    a, planes = anchors.astype(kind), Planes(rows, kind)
    less, more = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
    total, pairs = np.zeros(alive.shape, kind), None
    for weight, rest, plane in planes.each:
        if pairs is None:
            total += kind(weight) * (a @ plane.T)
            alive &= keep(total + kind(rest) * less[:, None], total + kind(rest) * more[:, None], alive, lambda v: v[:, None])
            if alive.mean() < SPARSE:
                i, j = np.nonzero(alive)
                pairs, total = (i, j), total[i, j]
        elif len(total):
            i, j = pairs
            for s in range(0, len(i), 1 << 14):
                part = slice(s, s + (1 << 14))
                total[part] += kind(weight) * np.einsum("pd,pd->p", a[i[part]], plane[j[part]])
            ok = keep(total + kind(rest) * less[i], total + kind(rest) * more[i], None, lambda v, i=i: v[i])
            pairs, total = (i[ok], j[ok]), total[ok]
    if pairs is None:
        pairs = np.nonzero(alive)
        total = total[pairs]
    return *pairs, total.astype(np.int64)


class Best:
    """The k highest scores of each of n lists, ties by smaller id; a score and id that repeat count once."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.ids = k, np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        lists = np.unique(at)
        at = np.concatenate([at, np.repeat(lists, self.k)])
        score, ids = np.concatenate([score, self.score[lists].ravel()]), np.concatenate([ids, self.ids[lists].ravel()])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        new = np.append(True, (at[1:] != at[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1]))
        at, score, ids = at[new], score[new], ids[new]
        first = np.searchsorted(at, at)
        keep = np.arange(len(at)) - first < self.k
        self.score[lists], self.ids[lists] = NONE, np.iinfo(np.int64).max
        self.score[at[keep], (np.arange(len(at)) - first)[keep]] = score[keep]
        self.ids[at[keep], (np.arange(len(at)) - first)[keep]] = ids[keep]


class Positives:
    """The first k other rows of its label for each anchor of a tile."""

    def __init__(self, ids, keys, labels, x, _scores, k: int):
        self.ids, self.keys, self.labels, self.x, self.best = ids, keys, labels, x, Best(len(ids), k)

    def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        least = self.best.score[:, -1].astype(np.float64)  # the k-th best so far; rounded, it may only keep more
        least = np.nextafter(least, -np.inf)
        once = np.isin(np.arange(len(ids)), np.unique(ids, return_index=True)[1])  # rows that repeat an id take one place of k

        def keep(low, high, alive, at):
            if alive is not None and low.shape[1] >= self.best.k:
                kth = np.partition(np.where(alive & once, low, -np.inf), low.shape[1] - self.best.k, axis=1)[:, low.shape[1] - self.best.k]
                np.maximum(least, np.nextafter(kth.astype(np.float64), -np.inf), out=least)
            return high >= at(least)

        i, j, score = sift(self.x, x, (self.labels[:, None] == labels[None, :]) & (self.ids[:, None] != ids[None, :]), keep)
        self.best.add(i, score, ids[j])

    def found(self) -> pa.RecordBatch:
        i, k = np.nonzero(self.best.score != NONE)
        columns = [self.ids[i], self.keys[i], self.best.ids[i, k], self.best.score[i, k]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "key", "vec_id", "score"])


class Negatives:
    """For each anchor of a tile and each of its positive scores, the first k rows of other labels whose score is in the window."""

    def __init__(self, ids, keys, labels, x, scores: np.ndarray, k: int):
        self.ids, self.keys, self.labels, self.x, self.scores = ids, keys, labels, x, scores
        self.low = np.where(scores == NONE, 1, -(-scores // 2))
        self.high = np.where(scores == NONE, 0, scores - -(-scores // 20))  # 95 % of a whole number, rounded down, without overflow
        self.best = Best(scores.size, k)

    def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        kth = self.best.score[:, -1].reshape(self.scores.shape)
        least = np.nextafter(np.maximum(self.low, kth).astype(np.float64), -np.inf)
        most = np.nextafter(np.where(self.high < self.low, -np.inf, self.high.astype(np.float64)), np.where(self.high < self.low, -np.inf, np.inf))

        def keep(low, high, alive, at):
            return np.logical_or.reduce([(high >= at(least[:, k])) & (low <= at(most[:, k])) for k in range(least.shape[1])])

        i, j, score = sift(self.x, x, (self.labels[:, None] != labels[None, :]) & (self.ids[:, None] != ids[None, :]), keep)
        for k in range(self.scores.shape[1]):
            ok = (score >= self.low[i, k]) & (score <= self.high[i, k])
            self.best.add(i[ok] * self.scores.shape[1] + k, score[ok], ids[j[ok]])

    def found(self) -> pa.RecordBatch:
        i, k = np.nonzero(self.best.score != NONE)
        a, p = np.divmod(i, self.scores.shape[1])
        columns = [self.ids[a], self.keys[a], self.scores[a, p], self.best.ids[i, k], self.best.score[i, k]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "key", "positive_score", "negative_id", "negative_score"])


def _tiles(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, tuple]]:
    """(dimension, (ids, keys, labels, vectors, scores)) of a batch of (id, key, label, x, scores)."""
    ids, keys, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    x, scores = batch.column(3), batch.column(4)
    start, n = x.offsets.to_numpy()[:-1], np.diff(x.offsets.to_numpy())
    flat, many = x.values.to_numpy(zero_copy_only=False), np.diff(scores.offsets.to_numpy())
    given = np.full((len(ids), max(1, many.max(initial=1))), NONE)
    given[np.arange(given.shape[1]) < many[:, None]] = scores.flatten().to_numpy(zero_copy_only=False)
    for dim in np.unique(n):
        at = np.flatnonzero(n == dim)
        for a in range(0, len(at), size):
            some = at[a : a + size]
            yield int(dim), (ids[some], keys[some], labels[some], flat[start[some][:, None] + np.arange(dim)].astype(np.int64), given[some])


def _met(asked: DataFrame, rows: DataFrame, kind: type, k: int, schema: str) -> DataFrame:
    """What ``kind`` finds for ``asked`` (id, key, label, x, scores) among ``rows`` (id, label, x).

    Blocks of anchors and parts of the rows meet in the cells of a grid, dealt by a shuffle. A cell holds its anchors
    and streams its rows; there are as many parts as keep the shuffle's tasks busy, so that a cell of many rows stays one
    list of answers.
    """
    spark = rows.sparkSession
    n = asked.agg(F.coalesce(F.sum(F.size("x") * 4), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n // ANCHOR_BYTES))
    n_parts = max(1, min(-(-rows.count() // PART_ROWS), -(-4 * n_partitions(spark) // n_blocks)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pick = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    none = F.array().cast("array<long>")
    a = asked.select(pick(n_blocks, 0).alias("block"), each(n_parts).alias("part"), F.lit(0).alias("side"), "id", "key", "label", "x", "scores")
    r = rows.select(each(n_blocks).alias("block"), pick(n_parts, 1).alias("part"), F.lit(1).alias("side"), "id", F.lit(0).cast("long").alias("key"), "label", "x", none.alias("scores"))
    dealt = a.unionByName(r).repartition(n_blocks * n_parts, "block", "part").sortWithinPartitions("block", "part", "side")

    def run(batches):
        cell, tiles = None, {}
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy().astype(np.int64)
            side = batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (side[1:] != side[:-1]))) if len(key) else []
            for s, e in zip(cuts, [*cuts[1:], len(key)]):
                if key[s] != cell:
                    yield from (t.found() for some in tiles.values() for t in some)
                    cell, tiles = key[s], {}
                some = pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(c).slice(s, e - s)]) for c in range(3, 8)], names=["id", "key", "label", "x", "scores"])
                if side[s] == 0:
                    for dim, (ids, keys, labels, x, scores) in _tiles(some, TILE_ANCHORS):
                        tiles.setdefault(dim, []).append(kind(ids, keys, labels, x, scores, k))
                    continue
                for dim, (ids, _, labels, x, _) in _tiles(some, TILE_ROWS):
                    for tile in tiles.get(dim, ()):
                        tile.meet(ids, labels, x)
        yield from (t.found() for some in tiles.values() for t in some)

    return dealt.mapInArrow(run, schema)


def hard_negatives(rows: DataFrame, label, is_anchor, positives: int = 5, negatives: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each of its first
    ``positives`` rows of the same label, the first ``negatives`` rows of other labels that score 50 to 95 % of the positive.

    A score is the inner product of the components ``floor(256 * x)``; higher ones come first, ties by smaller id. A
    component beyond 2**23 either way (x beyond 32,768) counts as that. ``label`` and ``is_anchor`` are columns over
    ``rows``. Rows with a null id, label or vector, or a null or non-finite component, take no part; zero vectors do, and
    empty ones meet only each other. Vectors of different dimensions never meet. A row with the anchor's own id is neither
    its positive nor its negative; rows that repeat an id with the same score count once. An anchor with fewer positives or
    negatives has those there are. Extra columns are ignored, whatever their names; an empty table, or one without
    anchors, gives an empty result.
    """
    whole = F.transform(F.col("vector"), lambda v: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), v * 256))).cast("int"))
    good = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), label.cast("long").alias("label"), is_anchor.alias("asked"))
    usable = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = good.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(usable, F.lit(False))).select("id", "label", whole.alias("x"), "asked")
    anchors = good.where("asked").select("id", F.xxhash64("label", "x").alias("key"), "label", "x").distinct()
    asked = anchors.withColumn("scores", F.array().cast("array<long>"))
    first = _met(asked, good, Positives, positives, "anchor_id long, key long, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    first = stored(first.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")
    mine = first.groupBy("anchor_id", "key").agg(F.sort_array(F.collect_set("score")).alias("scores")).select(F.col("anchor_id").alias("id"), "key", "scores")
    found = _met(anchors.join(mine, ["id", "key"]), good, Negatives, negatives, "anchor_id long, key long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "key", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    found = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    pairs = first.select("anchor_id", "key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(found, ["anchor_id", "key", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: DuckDB has no null or non-finite components in these tables.
SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
      FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""
