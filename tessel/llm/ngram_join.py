"""N-gram Jaccard self-join with set-relation skipping.

Documents with equal shingle sets are one set. Sets meet in prefix lists: shingles are ordered by how common they are
(a count sketch of fixed size tells), and two sets can only link if they share one of the rarest shingles of both. In a
list, parity bitmaps of the sets bound from below in how many shingles two of them differ; what hangs together by pairs
that may link is joined in one place: there an index of lists in blocks by size position lets a set skip blocks that
can't match, and a set's overlaps with all others are derived from those of the set before it, when both are much alike,
by the lists of the shingles they differ in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import runs
from .common import BROADCAST_ROWS, n_partitions, released, small_batches, stored
from .graph import components

#: Counters of the sketch (a power of two), and of a block of it.
SKETCH, SKETCH_BLOCK = 1 << 21, 1 << 13
#: Bytes of texts whose shingles are made at once.
TEXT_BYTES = 1 << 18
#: Shingles of the sets that are joined in one place, at most; larger groups are dealt out as pairs of parts.
GROUP_SHINGLES = 4_000_000
#: Bits of a bitmap in a list, at most: what a list takes grows with a text's length, not with its square.
MOST_BITS = 16_384
#: Shingles of a set, at most, that has a bitmap.
BITMAP_SHINGLES = 2 * MOST_BITS
#: Sets of a block of the index lists.
BLOCK_SETS = 1024

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
ROLL = np.random.default_rng(21).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(19, n.bit_length())
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x)]), dtype=np.uint64) for x in (STEP, BACK)]
    return _powers[0][:n], _powers[1][:n]


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text: of k words, or of all words where there are fewer."""
    buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    space = IS_SPACE[buf]
    edge = np.diff(space.astype(np.int8), prepend=1)
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(buf))
    value = BYTES[buf]
    value *= up
    value[space] = 0
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    word = _mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    bounds = np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    roll = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for j in range(k):
        roll += word[j : j + len(roll)] * ROLL[j : j + 1]
    roll = _mixed(roll)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(roll[a : b - k + 1]))
        elif b > a:
            whole = (word[a:b] * ROLL[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(_mixed(whole + ROLL[62 - (b - a)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]


def set_id(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity(found: np.ndarray) -> np.ndarray:
    """A bitmap, of half a bit to one bit for each shingle and MOST_BITS at most: which hash buckets hold an odd number of them. Of sets so large that it would tell nothing it is empty."""
    if len(found) > BITMAP_SHINGLES:
        return np.zeros(0, np.uint64)
    size = min(MOST_BITS, max(64, 1 << (len(found) - 1).bit_length() >> 1)) if len(found) > 1 else 64
    odd = np.bincount((found >> np.uint64(40)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (rows) of half the size: buckets are hashes modulo the size, so both halves add up."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def ordered(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles as keys whose order is that of the sketch's level, then the hash: rare ones first."""
    level = levels[(found & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(58)) | (found >> np.uint64(6)))


def _first_pass(k: int):
    """Of each document (doc_id, n, set_id, bits); of each task its sketch, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released(others=True)
        sketch = np.zeros(SKETCH, np.int32)
        for batch in runs(batches, 1, TEXT_BYTES):
            found = shingles(_texts(batch, 1), k)
            np.add.at(sketch, (np.concatenate(found) & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            n = [len(f) for f in found]
            ids, bits = [set_id(f) if len(f) else None for f in found], [parity(f).tobytes() if len(f) else None for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=["doc_id", "n", "set_id", "bits", "block", "counts"])
        blocks = SKETCH // SKETCH_BLOCK
        if sketch.any():
            held = np.minimum(sketch, 65_535).astype(np.uint16)  # a task's count; beyond that a shingle is common anyway
            counts = [held[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK].tobytes() for b in range(blocks)]
            long = pa.nulls(blocks, pa.int64())
            yield pa.RecordBatch.from_arrays([long, long, long, pa.nulls(blocks, pa.binary()), pa.array(range(blocks), pa.int32()), pa.array(counts, pa.binary())], names=["doc_id", "n", "set_id", "bits", "block", "counts"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            some = np.frombuffer(counts, np.uint16).astype(np.int64)
            total[b] = total[b] + some if b in total else some
    for b, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["block", "counts"])


def commonness(counts: np.ndarray) -> np.ndarray:
    """Levels 0 to 63 of counters: how far they stand out of what chance puts into each."""
    mean = counts.mean()
    excess = np.maximum(0, (counts - mean) / np.sqrt(mean + 1) - 2)
    return np.minimum(63, np.ceil(4 * np.log2(1 + excess))).astype(np.uint8)


def _prefixes(k: int, percent: int, levels):
    """(token, set_id, n) of the prefix of each set, once a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in runs(batches, 1, TEXT_BYTES):
            tokens, ids, sizes, times = [], [], [], []
            for found in shingles(_texts(batch, 1), k):
                n = len(found)
                if not n or (s := set_id(found)) in seen:
                    continue
                seen.add(s)
                some = ordered(found, levels.value)[: n - -(-percent * n // 100) + 1]
                tokens.append(some)
                ids.append(s), sizes.append(n), times.append(len(some))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), times)), pa.array(np.repeat(np.array(sizes, np.int32), times))], names=["token", "set_id", "n"])

    return run


def together(n: np.ndarray, bits: list[np.ndarray], percent: int) -> np.ndarray:
    """Of the sets of a list (sizes, bitmaps), the first that each hangs together with by pairs that may link."""
    g = len(n)
    words = np.array([len(b) for b in bits])
    group, rows, at = np.arange(g), {}, {}
    for w in np.unique(words):
        at[w] = np.flatnonzero(words == w)
        rows[w] = np.stack([bits[i] for i in at[w]])
    halved = {w: folded(b) for w, b in rows.items() if w // 2 in rows and w > 1}
    place = np.zeros(g, np.int64)
    for some in at.values():
        place[some] = np.arange(len(some))
    free = np.ones(g, bool)
    for first in range(g):
        if not free[first]:
            continue
        free[first] = False
        line = [first]
        while line and free.any():
            p = line.pop()
            w, mine = words[p], rows[words[p]][place[p]]
            if not w or 0 in at:  # without a bitmap only sizes tell
                left = np.flatnonzero(free) if not w else at[0][free[at[0]]]
                met = left[100 * np.minimum(n[left], n[p]) >= percent * np.maximum(n[left], n[p])]
                group[met], free[met] = first, False
                line.extend(met.tolist())
            for other, theirs, own in () if not w else ((w, rows[w], mine), (2 * w, halved.get(2 * w), mine), (w // 2, rows.get(w // 2), halved[w][place[p]] if w in halved else None)):
                if theirs is None or own is None or other not in at:
                    continue
                left = at[other][free[at[other]]]
                left = left[(100 * np.minimum(n[left], n[p]) >= percent * np.maximum(n[left], n[p]))]
                if not len(left):
                    continue
                differ = np.bitwise_count(theirs[place[left]] ^ own).sum(axis=1, dtype=np.int64)
                met = left[differ * (100 + percent) <= (100 - percent) * (n[left] + n[p])]
                group[met], free[met] = first, False
                line.extend(met.tolist())
    return group


def _edges(percent: int):
    """(u, v) that hang together in a list of (token, set_id, n, bits); lists come whole and one after another."""

    def run(batches):
        released(others=True)
        us, vs = [], []

        def close(ids, n, bits):
            if len(ids) < 2:
                return
            group = together(np.array(n, np.int64), [np.frombuffer(b, np.uint64) for b in bits], percent)
            for i, first in enumerate(group.tolist()):
                if i != first:
                    us.append(ids[i]), vs.append(ids[first])

        token, ids, n, bits = None, [], [], []
        for batch in batches:
            for t, s, size, b in zip(*(c.to_pylist() for c in batch.columns)):
                if t != token:
                    close(ids, n, bits)
                    token, ids, n, bits = t, [], [], []
                if not ids or ids[-1] != s:  # tasks repeat a set
                    ids.append(s), n.append(size), bits.append(b)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
                us, vs = [], []
        close(ids, n, bits)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        released()

    return run


def _sets(k: int, levels):
    """(comp, part, set_id, weight, keys) of the documents that stand for their sets."""

    def run(batches):
        for batch in runs(batches, 0, TEXT_BYTES):
            comp, part, ids, weight = (batch.column(c).to_pylist() for c in (1, 2, 3, 4))
            rows = []
            for c, p, s, w, found in zip(comp, part, ids, weight, shingles(_texts(batch, 0), k)):
                if len(found) and set_id(found) == s:  # else a row that repeats an id with another text
                    rows.append((c, p, s, w, ordered(found, levels.value).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["comp", "part", "set_id", "weight", "keys"])

    return run


class Index:
    """Lists of the sets (numbers in order of size) of a block that have a key."""

    def __init__(self, sets: list[np.ndarray], base: int):
        sizes = [len(s) for s in sets]
        keys, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        order = np.argsort(keys, kind="stable")
        self.owner, self.base, self.n = owner[order], base, len(sets)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.keys, self.first = keys[first], np.append(first, len(keys))

    def overlaps(self, keys: np.ndarray) -> np.ndarray:
        """Keys that each set of the block has in common with ``keys``."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        at = at[self.keys[at] == keys]
        if not len(at):
            return np.zeros(self.n, np.int64)
        a, n = self.first[at], self.first[at + 1] - self.first[at]
        where = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.owner[where], minlength=self.n)


def links(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of a set, numbers of the sets that it links with), sets being in order of size."""
    sizes = np.array([len(s) for s in sets], np.int64)
    index = [Index(sets[b : b + BLOCK_SETS], b) for b in range(0, len(sets), BLOCK_SETS)]
    held: dict[int, np.ndarray] = {}
    last = None
    for x, mine in enumerate(sets):
        n = len(mine)
        low = int(np.searchsorted(sizes, -(-percent * n // 100), "left"))
        high = int(np.searchsorted(sizes, 100 * n // percent, "right"))
        more = less = None
        if last is not None and held:
            more, less = np.setdiff1d(mine, sets[last], assume_unique=True), np.setdiff1d(sets[last], mine, assume_unique=True)
            if len(more) + len(less) > n // 2:
                more = None
        now, found = {}, []
        for b in range(low // BLOCK_SETS, -(-high // BLOCK_SETS)):  # other blocks hold no set of a fitting size
            lists = index[b]
            if more is not None and b in held:  # from the answers of the set before
                both = held[b]
                if len(more):
                    both = both + lists.overlaps(more)
                if len(less):
                    both = both - lists.overlaps(less)
            else:
                both = lists.overlaps(mine)
            now[b] = both
            theirs = sizes[lists.base : lists.base + lists.n]
            found.append(lists.base + np.flatnonzero(100 * both >= percent * (n + theirs - both)))
        held, last = now, x
        found = np.concatenate(found)
        yield x, found[found != x]


def _join(percent: int):
    """(set_id, root, links): of each set the smallest set it is linked with here, and the documents it links with."""

    def close(rows):
        rows = sorted({r[2]: r for r in rows}.values(), key=lambda r: (len(r[4]), r[4]))
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        side, weight = np.array([r[1] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        across = rows[0][0][1] != rows[0][0][2]  # by the cell's key: a cell of two parts may have sets of one only
        ids = np.array([r[2] for r in rows], np.int64)
        n_links, parent = np.zeros(len(rows), np.int64), np.arange(len(rows))

        def root_of(x):
            while (parent[x] != x).any():
                x = parent[x]
            return x

        for x, found in links(sets, percent):
            if across:
                found = found[side[found] != side[x]]
            if len(found):
                n_links[x] = weight[found].sum()
                met = np.unique(root_of(np.append(found, x)))
                parent[met] = met[0]
        group = root_of(np.arange(len(rows)))
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids)
        top = least[group]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(top), pa.array(n_links)], names=["set_id", "root", "links"])

    def run(batches):
        released(others=True)
        rows, key = [], None
        for batch in batches:
            for c, i, j, part, s, w, keys in zip(*(col.to_pylist() for col in batch.columns)):
                if (c, i, j) != key:
                    if len(rows) > 1:
                        yield close(rows)
                    rows, key = [], (c, i, j)
                rows.append((key, part, s, w, keys))
        if len(rows) > 1:
            yield close(rows)
        rows.clear()
        released()

    return run


def _parts(group: DataFrame, heavy: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sets with the part of their component, the cells (i, j) in which each part takes part): the parts of a heavy component are runs of its sets by size, and parts whose sizes can't match don't meet."""
    so_far = Window.partitionBy("comp").orderBy("n", "set_id").rowsBetween(Window.unboundedPreceding, -1)
    of_heavy = group.join(heavy, "comp", "left_semi").withColumn("part", F.floor(F.coalesce(F.sum("n").over(so_far), F.lit(0)) / GROUP_SHINGLES))
    of_heavy = stored(of_heavy, "parts")
    placed = group.join(heavy, "comp", "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(of_heavy)
    sizes = of_heavy.groupBy("comp", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    a, b = sizes.alias("a"), sizes.alias("b")
    met = a.join(b, (F.col("a.comp") == F.col("b.comp")) & (F.col("a.part") <= F.col("b.part")) & (100 * F.col("a.most") >= percent * F.col("b.least")))
    met = met.select("a.comp", F.col("a.part").alias("i"), F.col("b.part").alias("j"))
    cells = met.withColumn("part", F.col("i")).unionByName(met.where("i <> j").withColumn("part", F.col("j")))
    return placed, stored(cells, "cells")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``: one row for each row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z in lower case. A set holds the distinct shingles of ``k`` words
    of a whole text, or its whole sequence if it has fewer words; null and empty texts have no shingles and link with
    nothing. Two rows link when 100 * intersection >= percent * union. ``component_id`` is the smallest id that links
    reach; ``n_links`` counts the rows that a row links with, equal ones too. Rows that repeat an id each count as a row;
    a row with a null id links with nothing and has a null ``component_id``. Texts of any length are read whole: a set's
    postings take a bounded number of bytes for each shingle of its prefix. Sets are told apart by digests of 64 bits.
    Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    first = stored(rows.mapInArrow(_first_pass(k), "doc_id long, n long, set_id long, bits binary, block int, counts binary"), "sets")
    of_docs = first.where("block is null").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    summed = first.where("block is not null").select("block", "counts").repartition(n_partitions(spark), "block").mapInArrow(_add_up, "block int, counts binary").collect()
    counts = np.zeros(SKETCH, np.int64)
    for b, some in summed:
        counts[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK] = np.frombuffer(some, np.int64)
    levels = spark.sparkContext.broadcast(commonness(counts))
    sets = of_docs.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"))
    postings = rows.where("doc_id is not null").mapInArrow(_prefixes(k, percent, levels), "token long, set_id long, n int")
    of_token = Window.partitionBy("token")
    met = postings.withColumns({"least": F.min("set_id").over(of_token), "most": F.max("set_id").over(of_token)}).where("least < most").select("token", "set_id", "n")
    met = stored(met, "lists")
    bitmaps = first.where("set_id is not null").select("set_id", "bits").join(met.select("set_id").distinct(), "set_id", "left_semi").groupBy("set_id").agg(F.first("bits").alias("bits"))
    lists = met.join(bitmaps, "set_id").select("token", "set_id", F.col("n").cast("long").alias("n"), "bits")
    pairs = lists.repartition("token").sortWithinPartitions("token", "n", "set_id").mapInArrow(_edges(percent), "u long, v long").distinct()
    group = stored(components(pairs).join(sets, F.col("node") == F.col("set_id")).select("set_id", F.col("root").alias("comp"), "rep", "weight", "n"), "groups")
    heavy = group.groupBy("comp").agg(F.sum("n").alias("total")).where(F.col("total") > GROUP_SHINGLES).select("comp")
    n_heavy, n_sets = heavy.count(), group.count()
    placed, cells = _parts(group, heavy, percent) if n_heavy else (group.withColumn("part", F.lit(0).cast("long")), None)
    where = placed.select("comp", "part", "set_id", "weight", "rep")
    kept = rows.select(F.col("doc_id").alias("rep"), "text").join(F.broadcast(where) if n_sets <= BROADCAST_ROWS else where, "rep").select("text", "comp", "part", "set_id", "weight")
    full = kept.mapInArrow(_sets(k, levels), "comp long, part long, set_id long, weight long, keys binary")
    if cells is not None:
        full = full.join(F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells, ["comp", "part"], "left")
    else:
        full = full.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    dealt = full.select("comp", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("j", F.lit(0)).alias("j"), "part", "set_id", "weight", "keys")
    joined = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_join(percent), "set_id long, root long, links long")
    joined = stored(joined, "links")
    n_links = joined.groupBy("set_id").agg(F.sum("links").alias("links"))
    tops = components(joined.select("set_id", "root")).select(F.col("node").alias("set_id"), "root") if n_heavy else joined.select("set_id", "root")
    linked = sets.join(n_links, "set_id", "left").join(tops, "set_id", "left")
    linked = linked.select("set_id", "rep", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "set_id").alias("root"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = linked.join(least, "root").select("set_id", "component_id", "links")
    out = of_docs.join(classes, "set_id", "left")
    alone = F.col("set_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


#: All shared shingles as a self-join, and the closure of the links: for small tables.
SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS g FROM w),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM o WHERE 100 * c >= 85 * (nx + ny - c)),
r AS (SELECT doc_id, doc_id AS seen FROM s UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.seen = l.x),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY x)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links
FROM s JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
