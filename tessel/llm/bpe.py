"""Byte-level BPE by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up all neighbouring pairs by binary search over the
sorted pair keys, finds the lowest rank of each word and merges all places of that pair, left to right; words without
a known pair leave the array. The vocabulary file is a parameter and is read on the driver.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, released, small_batches

#: The white space and the split pattern of byte-level BPE vocabularies of this kind.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Two white-space characters in a row: there the place of a cut depends on what follows.
RUN_OF_SPACE = f"[{SPACE}][{SPACE}]"
#: A space or line end that stands alone between other characters: a text may always be cut before it.
ALONE = regex.compile(rf"(?<=[^{SPACE}])([ \n])(?=[^{SPACE}])")
CUT = "\0"
NO_RANK = np.int32(2**31 - 1)
#: Pieces of letters that all tables of Unicode know, digits and ASCII marks, and how they split into words.
LETTERS = "a-zA-ZÀ-ÖØ-öø-\u024f"
PLAIN = f"^[ \n]?[!-~{LETTERS}]+$"
PLAIN_WORD = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^ \n{LETTERS}0-9]+|\n"
#: Bytes of words and ids that a worker remembers.
REMEMBERED = 48 << 20
#: Bytes of unknown words merged at once; bytes of text digested at once.
MERGE_BYTES, DIGEST_BYTES = 1 << 20, 1 << 21
#: Pieces whose ids are laid out at once, so that a text of any length needs little more than itself.
BLOCK_PIECES = 1 << 16
#: Symbols of a word that the rounds take at most; longer ones are merged by a heap of their pairs, in n log n.
ROUND_SYMBOLS = 512


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by rule: visible Latin-1 as itself, the rest from U+0100."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A vocabulary: ``encode_words`` and ``decode`` in bulk, ``split`` for the words of a text."""

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int]):
        to_byte = byte_symbols()
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.pieces = [b""] * self.size
        for token, i in vocab.items():
            self.pieces[i] = bytes(to_byte[c] for c in token)
        self.special = special
        for token, i in special.items():
            self.pieces[i] = token.encode()
        self.first = np.zeros(256, np.int32)
        for c, b in to_byte.items():
            self.first[b] = vocab[c]
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs)))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order].astype(np.int32)
        both = (self.first.astype(np.int64)[:, None] * self.size + self.first[None, :]).ravel()
        found = np.minimum(np.searchsorted(self.keys, both), len(self.keys) - 1)
        self.first_at = np.where(self.keys[found] == both, found, -1).astype(np.int32)  # of pairs of bytes
        self.raw, self.decimal = pa.array(self.pieces, pa.large_binary()), pa.array([f"{i}," for i in range(self.size)], pa.large_string())
        self.pattern = regex.compile(PATTERN)
        self.stops = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    @classmethod
    def from_json(cls, raw: str) -> Bpe:
        x = json.loads(raw)
        return cls(x["model"]["vocab"], x["model"]["merges"], {t["content"]: t["id"] for t in x["added_tokens"]})

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens stand alone."""
        if self.stops is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out = []
        for part in self.stops.split(text):
            out.extend([part] if part in self.special else self.pattern.findall(part))
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in one flat array, number of ids of each word)."""
        blobs = [w.encode() for w in words]
        sizes = np.array([len(b) for b in blobs], np.int64)
        out_n = np.ones(len(words), np.int64)
        whole = np.array([self.special.get(w, -1) for w in words], np.int64) if self.special else np.full(len(words), -1)
        long = np.flatnonzero((sizes > ROUND_SYMBOLS) & (whole < 0))
        live = np.flatnonzero((whole < 0) & (sizes <= ROUND_SYMBOLS))
        sym = np.frombuffer(b"".join(blobs[i] for i in live), np.uint8).astype(np.int32)
        n = sizes[live]
        done_sym, done_word = [whole[whole >= 0].astype(np.int32)], [np.flatnonzero(whole >= 0)]
        for i in long.tolist():
            done_sym.append(self.merge_long(blobs[i]))
            done_word.append(np.full(len(done_sym[-1]), i))
            out_n[i] = len(done_sym[-1])
        starts = np.cumsum(n) - n
        at = np.full(len(sym), -1, np.int32)
        if len(sym):
            at[:-1] = self.first_at[sym[:-1] * 256 + sym[1:]]
            at[starts + n - 1] = -1
        sym = self.first[sym]
        rank = np.where(at >= 0, self.ranks[at], NO_RANK)
        while len(live):
            low = np.minimum.reduceat(rank, starts)
            ended = low == NO_RANK
            if ended.any():
                gone = np.repeat(ended, n)
                done_sym.append(sym[gone])
                done_word.append(np.repeat(live[ended], n[ended]))
                out_n[live[ended]] = n[ended]
                stay = ~gone
                sym, at, rank, live, low, n = sym[stay], at[stay], rank[stay], live[~ended], low[~ended], n[~ended]
                if not len(live):
                    break
            where = np.flatnonzero(rank == np.repeat(low, n))
            if len(where) > 1:  # in a run of one symbol, every second place
                new = np.diff(where, prepend=-2) != 1
                run = where[np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))]
                where = where[(where - run) % 2 == 0]
            sym[where] = self.made[at[where]]
            left = np.ones(len(sym), bool)
            left[where + 1] = False
            n = np.add.reduceat(left, np.cumsum(n) - n, dtype=np.int64)
            starts = np.cumsum(n) - n
            sym, at, rank = sym[left], at[left], rank[left]
            merged = where - np.arange(len(where))  # the new places of the merged symbols; pairs on both sides are new
            begins, ends = np.zeros(len(sym) + 1, bool), np.zeros(len(sym), bool)
            begins[starts], ends[starts + n - 1] = True, True
            at[merged], rank[merged] = -1, NO_RANK
            pair = np.concatenate([merged[~ends[merged]], merged[~begins[merged]] - 1])
            key = sym[pair].astype(np.int64) * self.size + sym[pair + 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[found] == key
            at[pair] = np.where(known, found, -1)
            rank[pair] = np.where(known, self.ranks[found], NO_RANK)
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        return sym[np.argsort(word, kind="stable")].astype(np.int64), out_n

    def merge_long(self, blob: bytes) -> np.ndarray:
        """The ids of one long word: its pairs by rank and place in a heap, its symbols in a linked list."""
        first = self.first[np.frombuffer(blob, np.uint8)].astype(np.int64)
        n = len(first)
        sym, after, before = first.tolist(), [*range(1, n), -1], [-1, *range(n - 1)]
        keys, ranks, made = self.listed
        found = np.minimum(np.searchsorted(self.keys, first[:-1] * self.size + first[1:]), len(keys) - 1)
        hit = np.flatnonzero(self.keys[found] == first[:-1] * self.size + first[1:])
        heap = list(zip(self.ranks[found[hit]].tolist(), hit.tolist(), found[hit].tolist()))
        heapq.heapify(heap)
        while heap:
            _, i, at = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j < 0 or sym[i] * self.size + sym[j] != keys[at]:
                continue  # merged meanwhile
            sym[i], sym[j], after[i] = made[at], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0:
                    key = sym[a] * self.size + sym[b]
                    at = bisect_left(keys, key)
                    if at < len(keys) and keys[at] == key:
                        heapq.heappush(heap, (ranks[at], a, at))
        return np.array([s for s in sym if s >= 0], np.int32)

    @functools.cached_property
    def listed(self) -> tuple[list[int], list[int], list[int]]:
        return self.keys.tolist(), self.ranks.tolist(), self.made.tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return laid_out(self.raw, ids)[0].tobytes()


def laid_out(parts: pa.Array, at: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """(the parts at these places one after another, where each begins and the last ends)."""
    made = parts.take(pa.array(at, pa.int64()))
    if not len(made):
        return memoryview(b""), np.zeros(1, np.int64)
    return memoryview(made.buffers()[2]), np.frombuffer(made.buffers()[1], np.int64)[: len(at) + 1]


def ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each run of n, one run after another."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Store:
    """The ids of words that a worker remembers, in one flat array. When it holds too many bytes, only what the last batch used stays."""

    def __init__(self, bpe: Bpe, most: int = REMEMBERED):
        self.bpe, self.most = bpe, most
        self.at, self.begin, self.n, self.ids, self.size = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of distinct words, number of ids of each)."""
        new = [w for w in words if w not in self.at]
        ids, n = [self.ids], [self.n]
        for run in self.runs(new):
            some, count = self.bpe.encode_words(run)
            ids.append(some), n.append(count)
        self.at.update(zip(new, range(len(self.n), len(self.n) + len(new))))
        self.ids, self.n = np.concatenate(ids), np.concatenate(n)
        self.begin = np.cumsum(self.n) - self.n
        self.size += sum(map(len, new)) + 200 * len(new)
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        n, found = self.n[at], self.ids[ragged(self.begin[at], self.n[at])]
        if self.size + 8 * len(self.ids) > self.most:
            self.at, self.n, self.ids = dict(zip(words, range(len(words)))), n, found
            self.begin, self.size = np.cumsum(n) - n, sum(map(len, words)) + 200 * len(words)
        return found, n

    def runs(self, words: list[str]) -> Iterator[list[str]]:
        """Words in runs of bounded bytes."""
        run, size = [], 0
        for w in words:
            run.append(w)
            size += 4 * len(w)
            if size > MERGE_BYTES:
                yield run
                run, size = [], 0
        if run:
            yield run


class Worker:
    """Digests texts: texts are cut into pieces, distinct pieces into words, and distinct words are merged, or remembered."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.store = bpe, Store(bpe)

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(pieces of all texts, none empty, number of pieces of each text): cut before each space or line end that stands alone."""
        runs_of = pc.match_substring_regex(texts, RUN_OF_SPACE).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(pc.replace_substring(texts, " ", CUT + " "), "\n", CUT + "\n")
        if runs_of.any():
            cut = pc.if_else(pa.array(runs_of), pa.array([ALONE.sub(CUT + r"\1", t) if r else None for t, r in zip(texts.to_pylist(), runs_of)], texts.type), cut)
        listed = pc.split_pattern(cut, CUT)
        stops = pc.match_substring(texts, CUT).to_numpy(zero_copy_only=False)
        for s in self.bpe.special:
            stops = stops | pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if stops.any():  # as words
            listed = pc.if_else(pa.array(stops), pa.array([self.bpe.split(t) if s else None for t, s in zip(texts.to_pylist(), stops)], listed.type), listed)
        return unlisted(listed)

    def words(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(words of all pieces, number of words of each piece)."""
        plain = pc.match_substring_regex(pieces, PLAIN)
        for s in self.bpe.special:
            plain = pc.and_not(plain, pc.match_substring(pieces, s))
        listed = pc.split_pattern(pc.replace_substring_regex(pieces, PLAIN_WORD, r"\0" + CUT), CUT)
        if not pc.all(plain).as_py():
            listed = pc.if_else(plain, listed, pa.array([None if p else self.bpe.split(t) for t, p in zip(pieces.to_pylist(), plain.to_pylist())], listed.type))
        return unlisted(listed)

    def digest(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """(numbers of ids, hex digests of the ids joined by commas, hex digests of the decoded texts)."""
        flat, n = self.pieces(pc.fill_null(texts, "").cast(pa.large_string()))
        coded = flat.dictionary_encode()
        words, n_words = self.words(coded.dictionary)
        coded_words = words.dictionary_encode()
        ids, n_ids = self.store.find(coded_words.dictionary.to_pylist())
        of_word = coded_words.indices.to_numpy()
        piece_ids = ids[ragged((np.cumsum(n_ids) - n_ids)[of_word], n_ids[of_word])]
        upto = np.concatenate([[0], np.cumsum(n_ids[of_word])])[np.concatenate([[0], np.cumsum(n_words)])]
        begin, size, code = upto[:-1], np.diff(upto), coded.indices.to_numpy()
        hashes, back = [hashlib.sha256() for _ in n], [hashlib.sha256() for _ in n]
        total, ends = np.zeros(len(n), np.int64), np.cumsum(n)
        for a in range(0, len(code), BLOCK_PIECES):
            b = min(len(code), a + BLOCK_PIECES)
            some = code[a:b]
            ids = piece_ids[ragged(begin[some], size[some])]
            first, last = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left")
            cuts = np.concatenate([[0], np.cumsum(size[some])])[np.concatenate([[0], ends[first:last] - a, [b - a]])]
            shown, shown_at = laid_out(self.bpe.decimal, ids)
            raw, raw_at = laid_out(self.bpe.raw, ids)
            for k, (i, j) in enumerate(zip(cuts.tolist(), cuts[1:].tolist()), int(first)):
                if i < j:
                    hashes[k].update(shown[shown_at[i] : shown_at[j] - (b >= ends[k])])  # no comma after the last
                    back[k].update(bytes(raw[raw_at[i] : raw_at[j]]).decode("utf-8", "replace").encode())
                    total[k] += j - i
        return total, [h.hexdigest() for h in hashes], [h.hexdigest() for h in back]

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for t in texts:
            yield self.bpe.encode_words(self.bpe.split(t))[0] if t else np.zeros(0, np.int64)


def unlisted(listed: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the strings of all lists that are not empty, how many each list has)."""
    flat, of = pc.list_flatten(listed), pc.list_parent_indices(listed)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), np.bincount(of.filter(full).to_numpy(), minlength=len(listed))


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read on the driver and broadcast: its size is that of the vocabulary, whatever the input."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _worker(raw) -> Worker:
    return held(("bpe", hash(raw.value)), lambda: Worker(Bpe.from_json(raw.value)))


def runs(batches: Iterator[pa.RecordBatch], text_at: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``most`` bytes of text, so that long texts don't add up; memory that Arrow holds back goes at the end."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0), np.int64)
        total, a = np.cumsum(sizes), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b
    released()


def gathered(batches: Iterator[pa.RecordBatch], text_at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``most`` bytes of text each, and cut where they have more."""
    held, size = [], 0
    for batch in runs(batches, text_at, most):
        n = batch.column(text_at).nbytes
        if held and size + n > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of each row's whole text; null and empty texts have no ids. Repeated rows stay repeated."""
    raw = vocabulary(docs.sparkSession, vocab_path)

    def run(batches):
        w = _worker(raw)
        for batch in runs(batches, 1):
            ids = [x.astype(np.int32) for x in w.ids(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of each row's ids, special tokens as their text; null ids give null, bytes that are no UTF-8 give U+FFFD."""
    raw = vocabulary(encoded.sparkSession, vocab_path)

    def run(batches):
        bpe = _worker(raw).bpe
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return small_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row's whole text, encoded and decoded in one pass.

    The digests are of the decimal ids joined by commas and of the text that the ids give back. Null counts as empty;
    repeated rows stay repeated; an empty table gives an empty result; extra columns are ignored.
    """
    raw = vocabulary(docs.sparkSession, vocab_path)

    def run(batches):
        w = _worker(raw)
        for batch in gathered(batches, 1, DIGEST_BYTES):
            n, ids, back = w.digest(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
