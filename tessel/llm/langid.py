"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a bounded sample of labelled text. A text is parsed
greedily into the longest phrases that an automaton knows; the language whose automaton needs the fewest phrases, each
weighed by the bits that a pointer into its sample costs, wins. All automata lie in one table, and many segments of
text walk through it in lockstep.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import gathered
from .common import held, small_batches

#: The sample of a language: so many rows with the smallest hashes of their ids, windows of so many characters from anywhere in them, so many characters in all.
SAMPLE_ROWS, WINDOW_CHARS, SAMPLE_CHARS = 96, 200, 20_000
#: Texts are parsed in segments of this many classes, so that a long text is as many lanes as it needs; of so many steps of a segment the states are kept; longer texts are parsed in parts of so many classes, one after another.
SEGMENT, TRACE, PART = 1024, 256, 1 << 20
#: Bytes of text times languages that are parsed in lockstep.
BATCH_BYTES = 1 << 24
SEPARATOR, UNKNOWN = 0, 1
#: Classes, the most frequent ones, whose edges lie in the table; those of all others lie in a sorted list.
DENSE = 252


class Automaton:
    """The suffix automaton of a sequence of classes: a table of the edges of the first DENSE classes, and the others as (state, class, to). State 0 is dead, state 1 the root."""

    def __init__(self, classes: list[int], n_classes: int):
        links, longest, edges = [0, 0], [0, 0], [{}, {}]
        last = 1
        for c in classes:
            new = len(links)
            links.append(0), longest.append(longest[last] + 1), edges.append({})
            p = last
            while p and c not in edges[p]:
                edges[p][c] = new
                p = links[p]
            if not p:
                links[new] = 1
            else:
                q = edges[p][c]
                if longest[q] == longest[p] + 1:
                    links[new] = q
                else:
                    copy = len(links)
                    links.append(links[q]), longest.append(longest[p] + 1), edges.append(dict(edges[q]))
                    while p and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = links[p]
                    links[q] = links[new] = copy
            last = new
        self.table = np.zeros((len(links), min(n_classes, DENSE)), np.int32)
        rare = []
        for s, e in enumerate(edges):
            for c, to in e.items():
                if c < self.table.shape[1]:
                    self.table[s, c] = to
                else:
                    rare.append((s, c, to))
        self.rare = np.array(rare, np.int64).reshape(-1, 3)


class Parser:
    """Automata of several languages over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        seen = Counter(c for s in samples.values() for c in s.lower() if c.isalpha())
        letters = sorted(seen, key=lambda c: (-seen[c], c))
        number = {c: k + 2 for k, c in enumerate(letters)}
        self.n_classes = len(letters) + 2
        self.classes = np.zeros(0x110000, np.uint8 if self.n_classes <= 256 else np.int32)
        for cp in range(0x110000):
            if (c := chr(cp)).isalpha():
                self.classes[cp] = number.get(c.lower(), UNKNOWN)
        tables, rare, self.roots, self.bits, at = [], [np.zeros((0, 3), np.int64)], [], [], 0
        self.width = width = min(self.n_classes, DENSE)
        for lang in self.langs:
            sample = self.read(samples[lang])
            automaton = Automaton(sample.tolist(), self.n_classes)
            table = automaton.table
            tables.append(np.where(table > 0, table + at, 0))
            rare.append(automaton.rare + np.array([at, 0, at]))
            self.roots.append(at + 1)
            self.bits.append(np.log2(max(2, len(sample))))
            at += len(table)
        self.table = np.concatenate(tables).astype(np.int32).ravel() * np.int32(width) if tables else np.zeros(0, np.int32)
        self.roots = np.array(self.roots, np.int32) * np.int32(width)
        self.bits = np.array(self.bits)
        rare = np.concatenate(rare)
        keys = rare[:, 0] * width * self.n_classes + rare[:, 1]
        order = np.argsort(keys)
        self.keys, self.to = keys[order], (rare[order, 2] * width).astype(np.int32)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states that the classes ``c`` (of the last axis) lead to; 0 where none."""
        if not len(self.keys):
            return self.table.take(state + c)
        out = self.table.take(state + np.where(c < self.width, c, 0))
        far = np.flatnonzero(c >= self.width)
        if len(far):
            key = state[..., far].astype(np.int64) * self.n_classes + c[far]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[..., far] = np.where(self.keys[at] == key, self.to[at], 0)
        return out

    def read(self, text: str) -> np.ndarray:
        """Classes of a text: letters in lower case, and one separator for each run of anything else."""
        x = self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        return x[(x > 0) | np.append(True, x[:-1] > 0)] if len(x) else x

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each language needs for each text, by the greedy parse: (texts, languages)."""
        out = np.zeros((len(texts), len(self.langs)))
        short = [i for i, t in enumerate(texts) if len(t) <= PART]
        out[short] = self.parse([texts[i] for i in short], np.zeros((len(self.roots), len(short)), np.int32))[0].T
        for i, t in enumerate(texts):
            state = np.zeros((len(self.roots), 1), np.int32)
            for a in range(0, len(t), PART) if len(t) > PART else ():
                count, state = self.parse([t[a : a + PART]], state)
                out[i] += count[:, 0]
        return out

    def advance(self, state: np.ndarray, count: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after the classes ``c``; a phrase that can't go on ends, and ``count`` has one more."""
        to = self.step(state, c)
        missed = np.flatnonzero(to.ravel() == 0)
        if len(missed):
            lang, lane = missed // len(c), missed % len(c)
            count[lang, lane] += 1
            to[lang, lane] = self.step(self.roots[lang], c[lane])  # none: the class is a phrase of its own
        return to

    def parse(self, texts: list[np.ndarray], begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases begun, states at the end) of each text, which begins in the states ``begin``: both (languages, texts).

        Segments first go in lockstep as if no phrase was open where they begin. Then each goes again from the state in
        which the one before it ended, until it is in the state in which it was before: from there on nothing changes.
        A segment that does not get there ends in another state, and the one after it goes once more.
        """
        n = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate([*texts, np.zeros(1)]).astype(np.int32)
        parts = np.maximum(1, -(-n // SEGMENT))
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(n[owner] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-size, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        owner, nth, size = owner[order], nth[order], size[order]
        start = (np.cumsum(n) - n)[owner] + nth * SEGMENT
        inner = np.flatnonzero(nth > 0)
        before, after = place[order[inner] - 1], np.full(len(order), -1)
        after[before] = inner

        state = np.zeros((len(self.roots), len(order)), np.int32)
        state[:, nth == 0] = begin[:, owner[nth == 0]]
        total, trace = np.zeros(state.shape, np.int32), []
        lanes = np.searchsorted(-size, -np.arange(SEGMENT), "left")  # of size over t
        for t in range(int(size[0]) if len(size) else 0):
            m = lanes[t]
            state[:, :m] = self.advance(state[:, :m], total[:, :m], flat[start[:m] + t])
            if t < TRACE and len(inner):
                trace.append((state[:, inner], total[:, inner]))
        first_end, first_total = state.copy(), total.copy()

        again = np.arange(len(inner))
        while len(again):
            lane = inner[again]
            now, count = state[:, before[again]], np.zeros((len(self.roots), len(again)), np.int32)
            settled = np.zeros(now.shape, bool)
            live = np.arange(len(again))
            for t in range(int(size[lane[0]])):
                live = live[(size[lane[live]] > t) & ~settled[:, live].all(axis=0)]
                if not len(live):
                    break
                some = count[:, live]
                to = self.advance(now[:, live], some, flat[start[lane[live]] + t])
                go = ~settled[:, live]
                now[:, live], count[:, live] = np.where(go, to, now[:, live]), np.where(go, some, count[:, live])
                if t < len(trace):
                    same = go & (to == trace[t][0][:, again[live]])
                    count[:, live] += np.where(same, first_total[:, lane[live]] - trace[t][1][:, again[live]], 0)
                    settled[:, live] |= same
            ended = np.where(settled, first_end[:, lane], now)
            changed = (ended != state[:, lane]).any(axis=0)
            state[:, lane], total[:, lane] = ended, count
            follow = after[lane[changed]]
            again = np.searchsorted(inner, np.sort(follow[follow >= 0]))
        out = np.zeros((len(texts), len(self.roots)), np.int64)
        np.add.at(out, owner, total.T)
        return out.T, state[:, place[np.cumsum(parts) - 1]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The winning language of each text and its share of the inverse costs; ties go to the first name."""
        read = [self.read(t or "") for t in texts]
        known = np.array([bool((x > 0).any()) for x in read], bool)
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        cost = np.maximum(self.phrases(read), 1) * self.bits[None, :]
        best = cost.argmin(axis=1)
        share = (1 / cost[np.arange(len(cost)), best]) / (1 / cost).sum(axis=1)
        return [self.langs[b] if k else "und" for b, k in zip(best, known)], [float(s) if k else 0.0 for s, k in zip(share, known)]


def _parser(samples: dict[str, str]) -> Parser:
    return held(("langid", hash(tuple(sorted(samples.items())))), lambda: Parser(samples))


def samples(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """For each language, the sample of its rows for which ``learn`` holds; bounded by the module's three parameters.

    Texts are whole: each is cut into windows in the order of their hashes, and all rows give their first window before
    any gives its second, until the characters are full.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    rows = docs.where(learn & F.col(lang_col).isNotNull() & (F.trim(F.coalesce(F.col(text_col), F.lit(""))) != ""))
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    some = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_ROWS)
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / WINDOW_CHARS).cast("int")))
    cut = some.select("id", "lang", "k", "text", at.alias("at")).select("lang", "k", "at", F.xxhash64("id", "at").alias("hash"), F.substring("text", F.col("at") * WINDOW_CHARS + 1, F.lit(WINDOW_CHARS)).alias("text"))
    cut = cut.where(F.trim("text") != "").withColumn("nth", F.row_number().over(Window.partitionBy("lang", "k").orderBy("hash", "at")))
    so_far = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("nth", "k").rowsBetween(Window.unboundedPreceding, -1))
    found = cut.withColumn("before", F.coalesce(so_far, F.lit(0))).where(F.col("before") < SAMPLE_CHARS).select("lang", "nth", "k", "text").collect()
    out: dict[str, str] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["nth"], r["k"])):
        out[r["lang"]] = (out.get(r["lang"], "") + " " + r["text"])[:SAMPLE_CHARS]
    return out


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, lang_pred, score`` of each row's whole text, learned from rows for which ``learn`` holds.

    Texts that are null or have no letter are ``und`` with score 0, and so is everything if nothing could be learned.
    Ties go to the first language name. Repeated rows stay repeated; extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(samples(docs, learn, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(sent.value)
        for batch in gathered(batches, 1, BATCH_BYTES // max(4, len(parser.langs))):
            lang, score = parser.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
