"""Exact dedup by an exchange of Golomb-coded fingerprints.

Every chunk of rows (a sender) sorts its distinct fingerprints and sends each owner of a fingerprint range its share,
coded as Golomb-Rice gaps. Owners decode what all senders sent and answer each with a bitmap of the fingerprints that
another sender has too. Only rows so marked (or repeated inside their chunk) are suspects: their texts are shuffled and
grouped byte by byte, with a map-side combine, so that a hot text costs one row a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import BROADCAST_ROWS, n_partitions, small_batches, stored

#: Rows of a sender.
CHUNK_BITS = 18
#: Fingerprints that an owner should get at most, on average.
OWNER_ROWS = 2_000_000
#: Rows of a group, at least, whose answer is broadcast instead of shuffled for.
HOT_ROWS = 10_000
#: Bits, at most, of the bitmap that keeps texts out of the shuffle when there are many suspects.
FILTER_BITS = 1 << 29


def golomb_encode(values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct values in [0, span) as (rice bits, unary quotients, packed remainders)."""
    n = len(values)
    if not n:
        return 0, b"", b""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    rice = max(0, int(math.log2(max(1, span // n))))
    quotient, rest = gaps >> rice, gaps & ((1 << rice) - 1)
    ends = np.cumsum(quotient + 1) - 1  # a zero ends each run of ones
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    bits = ((rest[:, None] >> np.arange(rice)[None, :]) & 1).astype(np.uint8)
    return rice, np.packbits(unary).tobytes(), np.packbits(bits.ravel()).tobytes()


def golomb_decode(n: int, rice: int, unary: bytes, rest: bytes) -> np.ndarray:
    """The values that golomb_encode was given."""
    if not n:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * rice].reshape(n, rice).astype(np.int64)
    low = (bits << np.arange(rice)[None, :]).sum(axis=1) if rice else np.zeros(n, np.int64)
    return np.cumsum(((quotient << rice) | low) + 1) - 1


def _senders(bits: int, owner_bits: int):
    span = 1 << (bits - owner_bits)

    def encode(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        fps = np.unique(table.column("fp").to_numpy())
        owner = fps >> (bits - owner_bits)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(fps)]):
            rice, unary, rest = golomb_encode(fps[a:b] & (span - 1), span)
            out.append((int(owner[a]), part, int(b - a), rice, unary, rest))
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["owner", "part", "n", "rice", "unary", "rest"])

    return encode


def _owners(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    lists = [golomb_decode(r["n"], r["rice"], r["unary"], r["rest"]) for r in rows]
    both = np.concatenate(lists)
    both.sort()
    twice = np.unique(both[1:][both[1:] == both[:-1]])
    marks = []
    for values in lists:
        at = np.searchsorted(twice, values)
        hit = (twice[np.minimum(at, len(twice) - 1)] == values) if len(twice) else np.zeros(len(values), bool)
        marks.append(np.packbits(hit).tobytes())
    return pa.table({"part": pa.array([r["part"] for r in rows], pa.int64()), "owner": pa.array([r["owner"] for r in rows], pa.int64()), "n": pa.array([r["n"] for r in rows], pa.int64()), "marks": pa.array(marks, pa.binary())})


def _suspects(mine: pa.Table, replies: pa.Table) -> pa.Table:
    """Rows of a sender whose fingerprint an owner marked, or that the sender itself has twice."""
    if not mine.num_rows:
        return pa.table({"sha": pa.array([], pa.binary())})
    fp = mine.column("fp").to_numpy()
    fps, inverse, count = np.unique(fp, return_inverse=True, return_counts=True)
    hit = np.concatenate([np.unpackbits(np.frombuffer(r["marks"], np.uint8))[: r["n"]] for r in sorted(replies.to_pylist(), key=lambda r: r["owner"])] or [np.zeros(0, np.uint8)])
    marked = (count > 1) | (hit > 0)
    first = np.unique(mine.column("sha").to_numpy(zero_copy_only=False)[marked[inverse]].astype(object)) if marked.any() else []
    return pa.table({"sha": pa.array(list(first), pa.binary())})


def _positions(sha: pa.Array, bits: int) -> np.ndarray:
    """The place of each digest (32 bytes) in a bitmap of so many bits, a power of two."""
    head = np.frombuffer(b"".join(x[:8] for x in sha.to_pylist()), ">u8")
    return (head >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def _bitmap(suspects: DataFrame, bits: int) -> bytes:
    """A bitmap with the places of all suspects set; its blocks are made apart and put together on the driver, whose share is bounded by FILTER_BITS."""
    block = min(bits, 1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            at = _positions(batch.column(1), bits)
            for b in np.unique(at // block).tolist():
                made.setdefault(b, np.zeros(block, bool))[at[at // block == b] % block] = True
        for b, some in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([np.packbits(some).tobytes()], pa.binary())], names=["block", "bits"])

    head = F.conv(F.substring(F.hex("sha"), 1, 8), 16, 10).cast("long")  # 32 bits
    blocks = suspects.select(F.shiftright(head, 32 - (bits // block).bit_length() + 1).alias("block"), "sha")
    found = blocks.repartition(n_partitions(suspects.sparkSession), "block").mapInArrow(run, "block long, bits binary").collect()
    out = bytearray(bits // 8)
    for b, some in found:
        out[b * block // 8 : (b + 1) * block // 8] = some
    return bytes(out)


def _of_suspects(texts: DataFrame, suspects: DataFrame) -> DataFrame:
    """Rows of ``texts`` (with ``sha``) whose digests are suspect. Up to BROADCAST_ROWS suspects are broadcast; more go into a bitmap that keeps most other texts out of the shuffle, which then tells exactly."""
    n = suspects.count()
    if n <= common.BROADCAST_ROWS:
        return texts.join(F.broadcast(suspects), "sha", "left_semi")
    bits = min(FILTER_BITS, 1 << max(20, (16 * n).bit_length()))
    sent = texts.sparkSession.sparkContext.broadcast(_bitmap(suspects, bits))
    at = texts.columns.index("sha")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            where = _positions(batch.column(at), bits)
            yield batch.filter(pa.array((held[where >> 3] >> (7 - (where & 7)).astype(np.uint8)) & 1 == 1))

    return small_batches(texts).mapInArrow(run, texts.schema).join(suspects.hint("shuffle_hash"), "sha", "left_semi")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint_bits: int = 48) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical, byte for byte; null counts as empty, and empty texts equal each other. Of equal
    texts the largest id stays; rows that repeat the staying id are all ``kept`` and all count in ``group_size``. A null
    id never stays while its group has another; a group of null ids only has a null ``keep_id`` and keeps its rows.
    Extra columns are ignored whatever their names; an empty table gives an empty result. Shorter fingerprints only add
    suspects: the verification is of whole texts.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    hexed = F.substring(F.hex("sha"), 1, (fingerprint_bits + 3) // 4)
    fp = F.shiftright(F.conv(hexed, 16, 10).cast("long"), -fingerprint_bits % 4)
    fps = stored(rows.withColumns({"fp": fp, "part": F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)}), "fingerprints")
    n_rows = fps.count()
    owner_bits = min(fingerprint_bits, max(3, math.ceil(math.log2(max(n_partitions(spark), n_rows / OWNER_ROWS, 1)))))
    sent = fps.select("part", "fp").groupBy("part").applyInArrow(_senders(fingerprint_bits, owner_bits), "owner long, part long, n long, rice int, unary binary, rest binary")
    replies = sent.groupBy("owner").applyInArrow(_owners, "part long, owner long, n long, marks binary")
    suspects = stored(fps.select("part", "fp", "sha").groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_suspects, "sha binary").distinct(), "suspects")
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    same = _of_suspects(texts, suspects).groupBy("sha", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = same.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("n_texts"))
    groups = groups.where("group_size > 1").select("sha", "keep_id", F.when(F.col("n_texts") > 1, F.raise_error(F.lit("two texts have one SHA-256"))).otherwise(F.col("group_size")).alias("group_size"))
    groups = stored(groups, "groups")
    # groups of so many rows that there are BROADCAST_ROWS of them at most
    hot = F.broadcast(groups.where(F.col("group_size") > max(HOT_ROWS, -(-n_rows // BROADCAST_ROWS))))
    ids = fps.select("doc_id", "sha")
    rest = ids.join(hot.select("sha"), "sha", "left_anti").join(groups, "sha", "left")
    out = ids.join(hot, "sha").unionByName(rest)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
