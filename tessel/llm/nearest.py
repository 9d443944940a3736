"""Nearest neighbours by a block matrix join of int8 tiles.

Vectors are quantised to int8 with one scale each, and the length of what quantisation lost is kept. A tile's product
then gives all distances of a block of queries to a block of rows, each right within the sum of the two losses. A row
survives for a query if its lower bound is not above the tenth smallest upper bound seen so far in the task; survivors
are computed again from the original vectors in double precision and merged by a bounded heap for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions

#: Bytes of queries, as doubles, that are broadcast at most, and of a block of queries if there are more; rows of a block of rows.
QUERY_BYTES, BLOCK_ROWS = 8 << 20, 1 << 20
#: Rows and queries of a tile.
TILE_ROWS, TILE_QUERIES = 4096, 1024
#: For sums of products of 8-bit values to be exact in single precision.
EXACT_DIMS = 1024


def usable(embedding: str = "embedding"):
    """Whether a vector takes part: not null or empty, all components finite and not null, not all zero."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(e, lambda x: x != 0)


class Tile:
    """Vectors (rows of ``x``, doubles) with their int8 form; ``lost`` bounds the distance between both."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        peak = np.abs(x).max(axis=1)
        scale = np.where(peak > 0, peak, 1) / 127
        self.q = np.rint(x / scale[:, None]).astype(np.int8)
        self.scale = scale
        near = self.q * scale[:, None]
        self.lost = np.sqrt(((x - near) ** 2).sum(axis=1)) * (1 + 1e-9)
        self.norm = (near**2).sum(axis=1)

    def about(self, other: Tile) -> np.ndarray:
        """Distances between the quantised vectors of two tiles: (rows of self, rows of other)."""
        dot = np.zeros((len(self.q), len(other.q)))
        for a in range(0, self.q.shape[1], EXACT_DIMS):
            dot += self.q[:, a : a + EXACT_DIMS].astype(np.float32) @ other.q[:, a : a + EXACT_DIMS].T.astype(np.float32)
        squares = self.norm[:, None] + other.norm[None, :] - 2 * dot * self.scale[:, None] * other.scale[None, :]
        return np.sqrt(np.maximum(squares, 0))


def exactly(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed in the order of the components."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += (a[:, k] - b[:, k]) ** 2
    return np.sqrt(total)


class Heaps:
    """The k nearest of each query so far, ordered by distance and id."""

    def __init__(self, n: int, k: int):
        self.k, self.d, self.ids = k, np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """Merges candidates: query (row of the heaps), distance, id."""
        rows = np.unique(query)
        q = np.concatenate([query, np.repeat(rows, self.k)])
        d = np.concatenate([d, self.d[rows].ravel()])
        ids = np.concatenate([ids, self.ids[rows].ravel()])
        order = np.lexsort((ids, d, q))
        q, d, ids = q[order], d[order], ids[order]
        new = np.append(True, (q[1:] != q[:-1]) | (d[1:] != d[:-1]) | (ids[1:] != ids[:-1]))  # a repeated row counts once
        q, d, ids = q[new], d[new], ids[new]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(first, np.diff([*first, len(q)]))
        keep = place < self.k
        self.d[q[keep], place[keep]], self.ids[q[keep], place[keep]] = d[keep], ids[keep]


def meet(queries: Tile, heap: Heaps, rows: Tile) -> None:
    """Merges a tile of rows into the heaps of a tile of queries; a row with the query's own id is no candidate."""
    about = queries.about(rows)
    slack = (queries.lost[:, None] + rows.lost[None, :]) * (1 + 1e-6) + 1e-7 * (1 + about)
    own = queries.ids[:, None] == rows.ids[None, :]
    bound = heap.d[:, -1]
    if len(rows.ids) >= heap.k:
        high = np.where(own, np.inf, about + slack)
        bound = np.minimum(bound, np.partition(high, heap.k - 1, axis=1)[:, heap.k - 1])
    at, row = np.nonzero((about - slack <= bound[:, None]) & ~own)
    for a in range(0, len(at), 1 << 16):
        i, j = at[a : a + (1 << 16)], row[a : a + (1 << 16)]
        heap.add(i, exactly(queries.x[i], rows.x[j]), rows.ids[j])


def _tiles(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, Tile]]:
    """(dimension, tile) of a batch of (id, embedding); vectors of different dimensions never meet."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    n = np.diff(lists.offsets.to_numpy())
    flat, start = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()[:-1]
    for dim in np.unique(n):
        at = np.flatnonzero(n == dim)
        x = flat[start[at][:, None] + np.arange(dim)[None, :]]
        for a in range(0, len(at), size):
            yield int(dim), Tile(ids[at[a : a + size]].astype(np.int64), x[a : a + size])


def nearest(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows by Euclidean distance of each row for which ``is_query`` holds.

    The search is exact. Ties go to the smaller id; fewer candidates than ``k`` are all returned. Rows with null ids,
    and vectors that are null, empty, zero or hold null or non-finite components, take no part; vectors of different
    dimensions are no candidates for each other. Rows that repeat an id and vector count once. Extra columns are ignored,
    whatever their names; an empty table, or one without queries, gives an empty result.
    """
    good = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), is_query.alias("q")).where(F.col("id").isNotNull() & usable("x"))
    asked = good.where("q").select("id", "x")
    n_bytes = asked.agg(F.sum(F.size("x") * 8)).first()[0] or 0
    found = _by_broadcast(good, asked, k) if n_bytes <= QUERY_BYTES else _by_cells(good, asked, k, -(-n_bytes // QUERY_BYTES))
    best = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SCHEMA = "query_id long, vec_id long, score double"


def _answers(queries: Tile, heap: Heaps) -> pa.RecordBatch:
    at, place = np.nonzero(np.isfinite(heap.d))
    return pa.RecordBatch.from_arrays([pa.array(queries.ids[at]), pa.array(heap.ids[at, place]), pa.array(heap.d[at, place])], names=["query_id", "vec_id", "score"])


def _by_broadcast(good: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Queries of QUERY_BYTES at most, which all tasks get; rows stay where they are."""
    queries: dict[int, list[Tile]] = {}
    for batch in asked.distinct().toArrow().to_batches():
        for dim, tile in _tiles(batch, TILE_QUERIES):
            queries.setdefault(dim, []).append(tile)
    sent = good.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        kept = {dim: [Heaps(len(q.ids), k) for q in tiles] for dim, tiles in sent.value.items()}
        for batch in batches:
            for dim, rows in _tiles(batch, TILE_ROWS):
                for q, heap in zip(sent.value.get(dim, []), kept.get(dim, [])):
                    meet(q, heap, rows)
        for dim, heaps in kept.items():
            for q, heap in zip(sent.value[dim], heaps):
                yield _answers(q, heap)

    return good.select("id", "x").mapInArrow(run, SCHEMA)


def _by_cells(good: DataFrame, asked: DataFrame, k: int, n_queries: int) -> DataFrame:
    """More queries: blocks of queries and blocks of rows meet in the cells of a grid, dealt by a shuffle. A cell holds its queries and streams its rows."""
    n_rows = max(1, -(-good.count() // BLOCK_ROWS))
    cells = lambda of, n, side: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(side)
    q = asked.distinct().select(F.pmod(F.xxhash64("id"), F.lit(n_queries)).cast("int").alias("qb"), cells(asked, n_rows, "rb"), F.lit(0).alias("side"), "id", "x")
    r = good.select(cells(good, n_queries, "qb"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_rows)).cast("int").alias("rb"), F.lit(1).alias("side"), "id", "x")
    dealt = q.unionByName(r).repartition(max(n_partitions(good.sparkSession), n_queries * n_rows), "qb", "rb").sortWithinPartitions("qb", "rb", "side")

    def run(batches):
        cell, queries, held, kept = None, {}, [], None
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy().astype(np.int64)
            side = batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (side[1:] != side[:-1])))
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                if key[a] != cell:
                    for dim in kept or ():
                        yield from (_answers(t, h) for t, h in kept[dim])
                    cell, held, kept = key[a], [], None
                some = pa.RecordBatch.from_arrays([batch.column(3).slice(a, b - a), pa.concat_arrays([batch.column(4).slice(a, b - a)])], names=["id", "x"])
                if side[a] == 0:
                    held.append(some)
                    continue
                if kept is None:
                    kept = {}
                    for part in pa.Table.from_batches(held).combine_chunks().to_batches() if held else ():
                        for dim, tile in _tiles(part, TILE_QUERIES):
                            kept.setdefault(dim, []).append((tile, Heaps(len(tile.ids), k)))
                for dim, rows in _tiles(some, TILE_ROWS):
                    for tile, heap in kept.get(dim, ()):
                        meet(tile, heap, rows)
        for dim in kept or ():
            yield from (_answers(t, h) for t, h in kept[dim])

    return dealt.mapInArrow(run, SCHEMA)


#: DuckDB has no null or non-finite components in these tables; the zero vector is left out.
SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
           WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda e: abs(e))) > 0),
p AS (SELECT q.vec_id AS query_id, r.vec_id, list_distance(q.x, r.x) AS score
      FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 10
"""
