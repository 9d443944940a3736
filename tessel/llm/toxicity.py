"""Toxicity by weak supervision.

Many voters look at a bounded sample of labelled rows: lexicons of words and of stems, drawn from terms that go with
the label, and patterns. A generative model with a hidden class, which the labels only start, estimates by EM how often
each voter fires in each class, and from what two voters still share given the class how far they repeat each other;
repeated evidence counts less. Its posterior trains a linear classifier over terms and patterns, which scores whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import runs, unlisted
from .common import released, small_batches, stored

#: Parameters of learning: labelled rows to learn from and terms in the lexicons, at most; likelihood ratio of a term, at least.
SAMPLE_ROWS, MAX_TERMS, LEAST_RATIO = 8_000, 1_000, 16.0
#: Least lifts of a term and rounds of EM to choose from, and the folds of the learning rows that choose.
LIFTS, ROUNDS, FOLDS = (4, 16, 64, 256), (2, 6, 30), 3
#: Lengths of stems.
STEMS = (4, 5, 6)
#: Lexicon voters of each kind of term, from those of the weakest terms to those of the strongest.
GROUPS = 4
#: Bytes of text whose terms are found at once.
TEXT_BYTES = 1 << 18
NO_WORD, UPPER = r"[^\p{L}\p{N}]+", r"^\p{Lu}{4,}$"
MASKED = r"\p{L}\*{2,}|\p{L}+[@$0-9]\p{L}+"
PATTERNS = ("masked", "shouted", "exclaimed")


def kinds_of(words: pa.Array) -> list[pa.Array]:
    """Words in lower case, and their stems of each length (null where a word is no longer)."""
    low = pc.utf8_lower(words)
    n = pc.utf8_length(low)
    return [low, *(pc.if_else(pc.greater(n, k), pc.utf8_slice_codeunits(low, 0, k), None) for k in STEMS)]


class Said:
    """The words of texts: the row and the number of the distinct word of each, and the distinct words."""

    def __init__(self, texts: pa.Array):
        self.texts = pc.fill_null(texts, "").cast(pa.large_string())
        flat, n = unlisted(pc.split_pattern(pc.replace_substring_regex(self.texts, NO_WORD, " "), " "))
        coded = flat.dictionary_encode()
        self.row, self.code, self.words = np.repeat(np.arange(len(n)), n), coded.indices.to_numpy(), coded.dictionary

    def distinct(self, number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of the words that have a number (0 to size - 1), each pair once."""
        found = number[self.code]
        both = np.unique(self.row[found >= 0] * np.int64(size) + found[found >= 0])
        return both // size, both % size


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, term, toxic rows, other rows) of runs of rows of (text, toxic)."""
    for batch in runs(batches, 0, TEXT_BYTES):
        said, toxic = Said(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
        for kind, terms in enumerate(kinds_of(said.words)):
            coded = terms.dictionary_encode()
            size = max(1, len(coded.dictionary))
            row, term = said.distinct(pc.fill_null(coded.indices, -1).to_numpy().astype(np.int64), size)
            a = np.bincount(term[toxic[row] == 1], minlength=size)
            b = np.bincount(term, minlength=size) - a
            if len(coded.dictionary):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), coded.dictionary.cast(pa.string()), pa.array(a), pa.array(b)], names=["kind", "term", "a", "b"])


class Lexicon:
    """Terms by kind; finds those of texts."""

    def __init__(self, found: list[tuple[int, str]]):
        self.terms = sorted(found)

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, number of a feature) for each feature that is on in a text: terms, then patterns."""
        said, n, size = Said(texts), len(texts), len(self.terms)
        rows, on, first = [], [], 0
        for kind, terms in enumerate(kinds_of(said.words)):
            mine = [t for k, t in self.terms if k == kind]
            if mine and len(said.words):
                row, term = said.distinct(pc.fill_null(pc.index_in(terms, pa.array(mine, pa.large_string())), -1).to_numpy().astype(np.int64), len(mine))
                rows.append(row), on.append(term + first)
            first += len(mine)
        upper = pc.match_substring_regex(said.words, UPPER).to_numpy(zero_copy_only=False)
        seen = (
            pc.match_substring_regex(said.texts, MASKED).to_numpy(zero_copy_only=False),
            np.bincount(said.row[upper[said.code]], minlength=n) > 2,
            (pc.count_substring(said.texts, "!").to_numpy() * 200 > pc.utf8_length(said.texts).to_numpy()),
        )
        for k, some in enumerate(seen):
            row = np.flatnonzero(some)
            rows.append(row), on.append(np.full(len(row), size + k))
        return np.concatenate(rows), np.concatenate(on)


def voters(terms: list[tuple[int, str]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The voter of each feature: the terms of a kind, in the order of how much they go with the label, form GROUPS lexicons."""
    out = np.zeros(x.shape[1], np.int64)
    kind = np.array([k for k, _ in terms], np.int64)
    a, b = (x[y == k, : len(terms)].sum(axis=0, dtype=float) for k in (1, 0))
    for k in range(len(STEMS) + 1):
        mine = np.flatnonzero(kind == k)
        order = mine[np.argsort((a[mine] + 0.5) / (b[mine] + 0.5), kind="stable")]
        out[order] = k * GROUPS + np.arange(len(order)) * GROUPS // max(1, len(order))
    out[len(terms) :] = GROUPS * (len(STEMS) + 1) + np.arange(len(PATTERNS))
    return out


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each row, weight of each voter). votes: rows x voters, 0 or 1; start: a first posterior."""
    p, weight = start.astype(float), np.ones(votes.shape[1])
    for k in range(rounds):
        one, two = p.sum() + 2, (1 - p).sum() + 2
        hit1, hit0 = (p @ votes + 0.5) / one, ((1 - p) @ votes + 0.5) / two
        if k >= rounds // 2 and (k - rounds // 2) % 5 == 0:  # what two voters share beyond the class
            left = votes - p[:, None] * hit1 - (1 - p)[:, None] * hit0
            cov = left.T @ left
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            shared = np.clip(cov / scale[:, None] / scale[None, :], 0, 1)
            weight = 1 / np.maximum(shared.sum(axis=1), 1)
        odds = votes @ (weight * np.log(hit1 / hit0)) + (1 - votes) @ (weight * np.log((1 - hit1) / (1 - hit0))) + np.log(prior / (1 - prior))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, weight


def fit_linear(x: np.ndarray, p: np.ndarray, steps: int = 200, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam; (weights, bias)."""
    x = x.astype(np.float32, copy=False)
    w, b = np.zeros(x.shape[1]), float(np.log((p.mean() + 1e-3) / (1 - p.mean() + 1e-3)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        left = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30))) - p
        g = np.append(x.T @ left.astype(np.float32) / len(p) + decay * w, left.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, np.asarray(weights, float), float(bias)

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, on = self.lexicon.features(texts)
        z = self.bias + np.bincount(row, self.weights[on], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def strong(x: np.ndarray, y: np.ndarray, n_terms: int, lift: float) -> np.ndarray:
    """Numbers of the terms whose likelihood ratio and (smoothed) lift in these rows are large enough."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    a, b = (x[y == k, :n_terms].sum(axis=0, dtype=float) for k in (1, 0))
    both = np.maximum(a + b, 1)
    ratio = 2 * sum(n * np.log(np.maximum(n, 1) * (n1 + n0) / (both * of)) for n, of in ((a, n1), (b, n0)))
    return np.flatnonzero((a > 1) & ((a + 0.5) * (n0 + 1) > lift * (b + 0.5) * (n1 + 1)) & (ratio >= LEAST_RATIO - 1e-6))


def fit(terms: list[tuple[int, str]], x: np.ndarray, y: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """(weights, bias) of the classifier on the label model's posterior, its scores scaled and shifted to fit the labels of the learning rows."""
    voter = voters(terms, x, y)
    votes = np.zeros((len(x), voter.max() + 1))
    for k in range(x.shape[1]):
        votes[:, voter[k]] = np.maximum(votes[:, voter[k]], x[:, k])
    posterior, _ = label_model(votes, float(np.clip(y.mean(), 0.01, 0.99)), 0.05 + 0.9 * y, rounds)
    w, b = fit_linear(x, posterior)
    scale, shift = fit_linear(((z := x @ w + b) - z.mean())[:, None], y)  # as the labels have it
    return w * scale[0], float((b - z.mean()) * scale[0] + shift)


def wrong(lift: float, rounds: int, terms_: list[tuple[int, str]], x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> int:
    """Rows that models of this lift and these rounds, each learned without the row's fold, score on the wrong side of their labels."""
    out = 0
    for f in range(FOLDS):
        rest, own = fold != f, fold == f
        if not own.any() or not 0 < y[rest].sum() < rest.sum():
            continue
        keep = strong(x[rest], y[rest], len(terms_), lift)
        some = x[:, np.append(keep, np.arange(len(terms_), x.shape[1]))]
        w, b = fit([terms_[k] for k in keep], some[rest], y[rest], rounds)
        out += int(((some[own] @ w + b >= 0) != y[own]).sum())
    return out


def learn(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of at most SAMPLE_ROWS labelled rows for whose ids ``usable`` holds (those with the smallest hashes).

    The least lift of a term and the rounds of EM are those of LIFTS and ROUNDS whose models err least on folds of these
    rows (the first of equals).
    Labels that are null are left out; of several labels of an id the largest counts, of several texts of an id the
    smallest. A sample of SAMPLE_ROWS rows and lexicons of MAX_TERMS terms (those of the highest likelihood ratio, ties
    by kind and term) bound what the driver holds, whatever the number of documents. Empty tables are as below. Without rows of both classes the
    model scores everything alike, by the share of label 1; where nothing is labelled, nothing is toxic.
    """
    marked = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    found = docs.join(F.broadcast(marked), F.col(id_col) == F.col("id")).select("id", F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col("toxic"))
    rows = stored(found.groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "labelled")
    counts = dict(rows.groupBy("toxic").count().collect())
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        share = min(max(n1 / (n1 + n0 + 1), 1e-6), 1 - 1e-6)
        return Model(Lexicon([]), np.zeros(len(PATTERNS)), float(np.log(share / (1 - share))))
    seen = small_batches(rows).mapInArrow(_terms_of, "kind int, term string, a long, b long").groupBy("kind", "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b, both = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    term_ratio = 2 * (a * F.log(a * (n1 + n0) / (both * n1)) + F.when(b > 0, b * F.log(b * (n1 + n0) / (both * n0))).otherwise(0))
    best = seen.where((a > 1) & ((a + 0.5) * (n0 + 1) > LIFTS[0] * (b + 0.5) * (n1 + 1))).withColumn("ratio", term_ratio).where(F.col("ratio") >= LEAST_RATIO)
    found = [(r["kind"], r["term"]) for r in best.orderBy(F.desc("ratio"), "kind", "term").limit(MAX_TERMS).collect()]
    lexicon = Lexicon(found)

    def features(batches):
        for batch in runs(batches, 0, TEXT_BYTES):
            row, on = lexicon.features(batch.column(0))
            order = np.lexsort((on, row))
            bounds = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(on[order], pa.int32()))
            fold = [zlib.crc32(t.encode()) % FOLDS for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([lists, batch.column(1), pa.array(fold, pa.int32())], names=["on", "toxic", "fold"])

    got = sorted((r["on"], r["toxic"], r["fold"]) for r in rows.mapInArrow(features, "on array<int>, toxic int, fold int").collect())
    x = np.zeros((len(got), len(found) + len(PATTERNS)), np.float32)
    for i, (on, _, _) in enumerate(got):
        x[i, on] = 1
    y, fold = np.array([t for _, t, _ in got], float), np.array([f for _, _, f in got])
    lift, rounds = min(((v, r) for v in LIFTS for r in ROUNDS), key=lambda vr: wrong(*vr, lexicon.terms, x, y, fold))
    keep = strong(x, y, len(found), lift)
    kept = [lexicon.terms[k] for k in keep]
    return Model(Lexicon(kept), *fit(kept, x[:, np.append(keep, np.arange(len(found), x.shape[1]))], y, rounds))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of each row's whole text; null counts as empty, and empty texts get the bias' score.

    Very long texts are scored whole, one at a time. Repeated rows stay repeated; extra columns are ignored, whatever
    their names; an empty table gives an empty result. A score of just 0.5 counts as toxic.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        released(others=True)
        for batch in runs(batches, 1, TEXT_BYTES):
            scores = sent.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all their columns, whose text the model scores under 0.5; null texts count as empty, repeated rows are judged alike, and an empty table gives an empty result."""

    def run(batches):
        released(others=True)
        for batch in runs(batches, at, TEXT_BYTES):
            yield batch.filter(pa.array(sent.value.scores(batch.column(at)) < 0.5))

    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    return small_batches(docs).mapInArrow(run, docs.schema)
