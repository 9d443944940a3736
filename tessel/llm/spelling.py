"""Spelling variants: words one edit apart, found by an inverted index of positional q-grams with a count filter.

Words that differ by one edit share all q-grams but the q that the edit touches, at positions that differ by one at most,
so that the rarest q + 1 grams of both have one in common. Words are dealt to cells by these grams and by length; a
cell holds an index from (gram, position) to the words of its length; a word of this length, or of one less, reads the
shortest of the postings that it asks for, all shared grams of the words there are counted, and those with enough of them
are compared. Cells are looked through many at once, in sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

Q = 3
#: Letters of words: a to z and the code points from C0 to FF (no other words are given); the grams of them all are 729,000.
LOW, LATIN, LETTERS = ord("a"), 0xC0, 26 + 64
#: Words that a part of a cell holds at most, about.
PART_WORDS = 20_000
RUN = "[A-Za-z\u00c0-\u00ff]"


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, occurrences: int = 2) -> DataFrame:
    """``word, n``: runs of letters of all whole texts, lower-cased from A to Z alone, with one letter deleted where the crc32 of id and run is a multiple of 31.

    Of length ``least`` and ``occurrences`` times in all at least. Null texts have none, a null id counts as empty.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("run"))  # whole runs: shorter ones don't match
    runs = runs.select("id", F.translate("run", upper, upper.lower()).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, gram) of all grams of all words, in order."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.where(codes >= LATIN, codes - LATIN + 26, codes - LOW)
    n = np.array([len(w) for w in words])
    grams = (codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:]
    word = np.repeat(np.arange(len(words)), np.maximum(n - Q + 1, 0))
    start = np.cumsum(n) - n
    return word, grams[np.arange(len(word)) - np.repeat(np.cumsum(np.maximum(n - Q + 1, 0)) - np.maximum(n - Q + 1, 0), np.maximum(n - Q + 1, 0)) + start[word]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS**Q, np.int64)
    for batch in batches:
        _, grams = _grams(batch.column(0).to_pylist())
        total += np.bincount(grams, minlength=len(total))
    gram = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int32)), pa.array(total[gram])], names=["gram", "n"])


#: A word's rare grams are longs: the rank above, and below the place of the gram in the word from 1, or 0 if it stands there more than once.
PLACE = (1 << 32) - 1
#: Rows of cells that are looked through together, about, and candidates that are compared at once.
CELL_ROWS, CANDIDATES = 1 << 13, 1 << 18


def _letters(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters and grams of words of one length, a row each."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32).reshape(-1, size)
    codes = np.where(codes >= LATIN, codes - LATIN + 26, codes - LOW)
    return codes.astype(np.uint8), (codes[:, :-2] * LETTERS + codes[:, 1:-1]) * LETTERS + codes[:, 2:]


def _expanded(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of all entries of the lists of each row."""
    row = np.repeat(np.arange(len(n)), n.sum(axis=1))
    start, n = start.ravel(), n.ravel()
    return row, np.arange(len(row)) + np.repeat(start - np.cumsum(n) + n, n)


def _compatible(a: np.ndarray, b: np.ndarray, shorter: bool) -> np.ndarray:
    """Whether one edit can bring a gram from one place to another; any place, if a word has it more than once."""
    fits = (a == 0) | (b == 0) | (a == b)
    return fits | (b == a + 1) if shorter else fits


class Cells:
    """An inverted index of the words of one length, from cell, gram and place to words, and what looks for words in it.

    ``rows`` are token, size, part, side, word, n, tokens, sorted; all of one size.
    """

    def __init__(self, rows: pa.Table, size: int):
        token, part, self.side = (rows.column(k).to_numpy() for k in (0, 2, 3))
        self.size, self.token, self.words = size, token, rows.column(4)
        self.cell = np.cumsum(np.append(False, (token[1:] != token[:-1]) | (part[1:] != part[:-1]))).astype(np.int64)
        listed = rows.column(6).combine_chunks()
        offsets, flat = listed.offsets.to_numpy(), listed.values.to_numpy()
        n = np.diff(offsets)
        self.rare = np.full((len(n), Q + 1), -1, np.int64)
        self.rare[np.repeat(np.arange(len(n)), n), np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], n)] = flat[offsets[0] : offsets[-1]]
        here = self.rare >> 32 == token[:, None]
        self.place = np.take_along_axis(self.rare, here.argmax(axis=1)[:, None], 1)[:, 0] & PLACE
        self.index, self.grams_of = np.flatnonzero(self.side < 2), size - Q + 1
        words = self.words.take(pa.array(self.index)).to_pylist()
        self.letters, self.grams = _letters(words, size)
        keys = self._keys(self.index, self.grams, 0).ravel()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        self.first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.known, self.n = keys[self.first], np.diff(np.append(self.first, len(keys)))
        self.owner = order // self.grams_of
        self.at = np.empty(len(order), np.int64)
        self.at[order] = np.arange(len(order))
        self.start = np.empty(len(order), np.int64)
        self.start[order] = np.repeat(self.first, self.n)

    def _keys(self, rows: np.ndarray, grams: np.ndarray, moved: int) -> np.ndarray:
        return (self.cell[rows][:, None] * self.grams_of + np.arange(grams.shape[1]) + moved) * LETTERS**Q + grams

    def _found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the postings of keys start, and how many they are."""
        k = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return self.first[k], np.where(self.known[k] == keys, self.n[k], 0)

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row that looks, row it finds) of all pairs one edit apart that no other cell has."""
        if not len(self.index):
            return
        mine = np.flatnonzero(self.side[self.index] == 1)
        start = self.start.reshape(-1, self.grams_of)[mine]
        yield from self._near(self.index[mine], self.letters[mine], self.grams[mine], start, self.at.reshape(-1, self.grams_of)[mine] - start)  # among those before
        for side in (2, 3):
            rows = np.flatnonzero(self.side == side)
            if not len(rows):
                continue
            letters, grams = _letters(self.words.take(pa.array(rows)).to_pylist(), self.size - (side == 2))
            start, n = self._found(self._keys(rows, grams, 0))
            if side == 2:
                later, more = self._found(self._keys(rows, grams, 1))
                start, n = np.stack([start, later], 2), np.stack([n, more], 2)
            yield from self._near(rows, letters, grams, start, n)

    def _near(self, rows, letters, grams, start, n):
        """A pair shares as many grams as one edit of the longer word leaves: so it is in one of the shortest lists of which that many less one are left out; all grams of those found there are counted."""
        if not len(rows):
            return
        shorter = start.ndim == 3
        least = self.size - 2 * Q + 1
        tried = min(grams.shape[1] - least + 1, grams.shape[1])
        if tried < grams.shape[1]:
            short = np.argpartition(n.sum(axis=2) if shorter else n, tried - 1, axis=1)[:, :tried]
            short = short[:, :, None] if shorter else short
            start, n = np.take_along_axis(start, short, 1), np.take_along_axis(n, short, 1)
        start, n = start.reshape(len(rows), -1), n.reshape(len(rows), -1)
        ends = np.cumsum(n.sum(axis=1))
        i = 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CANDIDATES, "right")))
            a, at = _expanded(start[i:j], n[i:j])
            a, b, i = a + i, self.owner[at], j
            fits = _compatible(self.place[rows[a]], self.place[self.index[b]], shorter)
            a, b = a[fits], b[fits]
            if shorter:
                x, y = grams[a], self.grams[b]
                shared = (x == y[:, :-1]) | (x == y[:, 1:])
            else:
                shared = grams[a] == self.grams[b]
            often = shared.sum(axis=1) >= least
            code = np.unique(a[often] * len(self.index) + b[often])
            a, b = code // len(self.index), code % len(self.index)
            x, y = letters[a], self.letters[b]
            if shorter:
                front, back = np.logical_and.accumulate(x == y[:, :-1], axis=1), np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1)
                near = front.sum(axis=1) + back.sum(axis=1) >= self.size - 1
            else:
                near = (x != y).sum(axis=1) == 1
            a, b = rows[a[near]], self.index[b[near]]
            first = self._first_shared(a, b, shorter)
            if len(a) and self.side[a[0]] == 3:  # both are in the index, and look
                after = np.array(self.words.take(pa.array(a)).to_pylist()) < np.array(self.words.take(pa.array(b)).to_pylist())
                first &= after
            yield a[first], b[first]

    def _first_shared(self, a: np.ndarray, b: np.ndarray, shorter: bool) -> np.ndarray:
        """Whether the gram of the cell is the first rare gram that two words share at places one edit can bring about."""
        x, y = self.rare[a][:, :, None], self.rare[b][:, None, :]
        both = ((x >> 32 == y >> 32) & (x >= 0) & _compatible(x & PLACE, y & PLACE, shorter)).any(axis=2)
        at = np.take_along_axis(self.rare[a], both.argmax(axis=1)[:, None], 1)[:, 0] >> 32
        return both.any(axis=1) & (at == self.token[a])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the cells of a partition. Of a cell's rows those that are only looked for come first (side 0), then those that look among the ones before them too (1), then those that only look (2; 3: they are in the index as well)."""

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = rows.column(1).to_numpy()
        bounds = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1), len(sizes)]
        for at, end in zip(bounds[:-1], bounds[1:]):
            some = rows.slice(at, end - at).combine_chunks()
            for a, b in Cells(some, int(sizes[at])).near():
                if len(a):
                    columns = [some.column(k).take(pa.array(x)).combine_chunks() for x in (a, b) for k in (4, 5)]
                    yield pa.RecordBatch.from_arrays(columns, names=["a", "a_n", "b", "b_n"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < CELL_ROWS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        cell = [rows.column(k).to_numpy() for k in range(3)]
        last = int(np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cell], axis=0)))[-1])
        if last:
            yield from found(rows.slice(0, last))
        rest = rows.slice(last).combine_chunks()
        if rest.num_rows >= CELL_ROWS + PART_WORDS:
            # what looks has looked; its index stays for those to come
            yield from found(rest)
            rest = rest.filter(pa.array(rest.column(3).to_numpy() < 2))
            rest = rest.set_column(3, rest.schema.field(3), pa.array(np.zeros(rest.num_rows), rest.schema.field(3).type)).combine_chunks()
        held = rest.to_batches()
    if any(b.num_rows for b in held):
        yield from found(pa.Table.from_batches(held).combine_chunks())


def near_words(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n`` of each pair of ``words`` (word, n; Q + 1 letters at least, all of a-z and C0-FF) one edit apart, once."""
    spark = words.sparkSession
    counts = words.select("word").mapInArrow(_counted, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    rank = np.zeros(LETTERS**Q, np.int32)
    gram, n = counts.column("gram").to_numpy(), counts.column("n").to_numpy()
    rank[gram[np.lexsort((gram, n))]] = np.arange(len(gram))
    ranks = spark.sparkContext.broadcast(rank)

    def rarest(batches):
        for batch in batches:
            some = batch.column(0).to_pylist()
            word, grams = _grams(some)
            r = ranks.value[grams]
            order = np.lexsort((r, word))
            first = np.searchsorted(word, np.arange(len(some)))
            place = np.arange(len(word)) - first[word[order]]
            word, r, where = word[order], r[order].astype(np.int64), (order - first[word[order]]) + 1
            new = np.append(True, (word[1:] != word[:-1]) | (r[1:] != r[:-1])) if len(word) else np.zeros(0, bool)
            again = np.append(~new[1:], False) if len(word) else new
            code, kept = r << 32 | np.where(again, 0, where), new & (place <= Q)
            offsets = np.searchsorted(word[kept], np.arange(len(some) + 1)).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(code[kept]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], names=["word", "n", "tokens"])

    sized = stored(words.select("word", "n").mapInArrow(rarest, "word string, n long, tokens array<long>").withColumn("size", F.length("word")), "grams")
    # each word to the cells of its own length; and to those of the next, for which one rare gram less will do
    own = F.transform("tokens", lambda t: F.struct(F.shiftright(t, 32).cast("int").alias("token"), F.col("size").alias("size"), F.lit(1).alias("side")))
    asks = F.transform(F.slice("tokens", 1, Q), lambda t: F.struct(F.shiftright(t, 32).cast("int").alias("token"), (F.col("size") + 1).alias("size"), F.lit(2).alias("side")))
    dealt = sized.select("word", "n", "tokens", F.explode(F.concat(own, asks)).alias("to")).select("word", "n", "tokens", "to.token", "to.size", "to.side")
    large = dealt.where("side = 1").groupBy("token", "size").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > PART_WORDS)
    large = stored(large.select("token", "size", F.ceil(F.col("many") / PART_WORDS).cast("int").alias("parts")), "large-cells")
    if large.limit(1).count():
        # a large cell's words are dealt to parts, and ask in all of them
        dealt = dealt.join(large, ["token", "size"], "left")
        asks = F.when(F.col("side") == 1, 3).otherwise(2)
        all_parts = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), asks.alias("side")))
        mine = F.array(F.struct(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side")))
        whole = F.array(F.struct(F.lit(0).alias("part"), F.col("side")))
        to = F.when(F.col("parts").isNull(), whole).when(F.col("side") == 1, F.concat(mine, all_parts)).otherwise(all_parts)
        dealt = dealt.withColumn("to", F.explode(to)).select("token", "size", "to.part", "to.side", "word", "n", "tokens")
    else:
        dealt = dealt.select("token", "size", F.lit(0).alias("part"), "side", "word", "n", "tokens")
    dealt = dealt.repartition("token", "size", "part").sortWithinPartitions("size", "token", "part", "side")
    return dealt.mapInArrow(_pairs, "a string, a_n long, b string, b_n long")


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each row of ``words`` (word, n).

    ``n_near`` counts the words one inserted, deleted or replaced letter away; ``form`` is the one of them with the largest
    n, ties to the first in code-point order, if that is at least ``times`` the word's own, else null. ``root`` follows
    forms to the last one; n grows tenfold at each step, so that a few rounds of pointer doubling reach it. Words are
    unique and n positive, as ``words_of`` gives them; words of fewer than seven letters are not found by the grams and
    must not be given. A word of any length is one row. No words give an empty result.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_words(words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word"))).alias("best"))
    near = stored(best.select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.less")).alias("near_n")), "best")
    has = F.col("near_n") >= times * F.col("n")
    out = words.join(near, "word", "left").select("word", F.when(has, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("near_n")).alias("form_n"))
    out = stored(out, "forms")
    steps, most = 0, (out.agg(F.max("n")).first()[0] or 0)
    while most >= times:
        steps, most = steps + 1, most // times
    roots = out.where("form is not null").select(F.col("word").alias("key"), F.col("form").alias("root"))
    for _ in range(max(steps - 1, 0).bit_length()):
        on = roots.select(F.col("key").alias("root"), F.col("root").alias("further"))
        roots = stored(roots.join(on, "root", "left").select("key", F.coalesce("further", "root").alias("root")), "roots")
    found = out.join(roots, F.col("word") == F.col("key"), "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: One-edit pairs by deletions: a replaced letter leaves the same rest at the same place, an inserted one the shorter word.
SQL = r"""
WITH RECURSIVE run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
one AS (SELECT doc_id, r, count(*) AS n FROM run WHERE length(r) >= 7 GROUP BY ALL),
hexed AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS h FROM one),
crc AS (SELECT r, n, xor(4294967295, list_reduce(
          list_concat([4294967295::BIGINT], flatten(list_transform(range(0, length(h) // 2), lambda k:
            list_transform(range(8), lambda b: (('0x' || substr(h, 2 * k + 1, 2))::BIGINT >> b) & 1)))),
          lambda c, bit: CASE WHEN xor(c & 1, bit) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS h FROM hexed),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, CAST(h % length(r) AS INT)) || substr(r, CAST(h % length(r) AS INT) + 2) ELSE r END AS word, n FROM crc),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT x.word AS a, y.word AS b, y.n AS b_n FROM d x JOIN d y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
      UNION SELECT x.word, y.word, y.n FROM d x JOIN w y ON x.rest = y.word
      UNION SELECT y.word, x.word, x.n FROM d x JOIN w y ON x.rest = y.word),
best AS (SELECT a, b, b_n, count(*) OVER (PARTITION BY a) AS n_near FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY b_n DESC, b) = 1),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 10 * n THEN b END AS form, CASE WHEN b_n >= 10 * n THEN b_n END AS form_n FROM w LEFT JOIN best ON a = word),
chain AS (SELECT word, form AS node, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN f ON f.word = c.node WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(node, step) AS root FROM chain GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN last ON last.word = f.word
"""
