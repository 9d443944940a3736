"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of the component of each of n nodes, by edges (a, b) between node numbers."""
    parent = np.arange(n)
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        if (parent == before).all():
            return parent


#: Edges, after the first contraction, that one task finishes; more take the rounds.
SMALL_EDGES = 1 << 20


def _shrink(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Edges as stars around the smallest node of each of their components."""
    u, v = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    top = nodes[roots(at[: len(u)], at[len(u) :], len(nodes))]
    other = nodes != top
    return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(top[other])], names=["u", "v"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if held := list(batches):
        yield _shrink(held)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars around the smallest node of each of their components, in runs of bounded size."""

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > 1 << 20:
            yield _shrink(held)
            held, size = [], 0
    if size:
        yield _shrink(held)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (two long columns): root is the smallest node that it reaches.

    Edges are contracted inside the partitions; SMALL_EDGES or fewer are then finished by one task. More alternate
    large-star and small-star; each round is stored, and a round that changes nothing ends it. A hub's edges meet its minimum in a join, so that its partition can be split.
    Loops and repeated edges do no harm; no edges give no rows.
    """
    u, v = edges.columns
    now = stored(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").mapInArrow(_forest, "u long, v long").distinct(), "edges")
    small = now.count() <= SMALL_EDGES
    if small:
        now = stored(now.coalesce(1).mapInArrow(_whole, "u long, v long"), "edges")
    mark = None
    while not small:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 16)).alias("h"), F.max("u").alias("top")).first()
        if not state["n"] or state == mark:
            break
        mark = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        star = down.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = stored(star.where("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
