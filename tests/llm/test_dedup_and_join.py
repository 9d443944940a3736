import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import common, exact_dedup, graph, ngram_join

DOC = "doc_id long, text string, sha string, part int, n int, token string, set_id string"


def frame(spark, texts, schema=DOC):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", "z") for i, t in texts], schema)


@given(st.sets(st.integers(0, 9_999)), st.sampled_from([10_000, 1 << 20]))
def test_golomb_round_trip(values, span):
    v = np.array(sorted(values), np.int64)
    assert exact_dedup.golomb_decode(len(v), *exact_dedup.golomb_encode(v, span)).tolist() == v.tolist()


TEXTS = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b"), (5, "b"), (None, "c"), (None, "c"), (6, "c"), (7, "A"), (8, "a "), (9, "x" * 100_000), (10, "x" * 100_000), (None, "d")]


@pytest.mark.parametrize(("bits", "hot", "most"), [(48, 10_000, 1_000_000), (3, 10_000, 1_000_000), (48, 1, 1_000_000), (48, 1, 0)])
def test_exact_dedup(spark, monkeypatch, bits, hot, most):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot), monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    texts = TEXTS + [(100 + i, f"t{i % 40}") for i in range(90)]
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((repr(i), repr(keep[t or ""]), len(groups[t or ""]), i == keep[t or ""]) for i, t in texts)
    got = exact_dedup.exact_dedup(frame(spark, texts).repartition(5), fingerprint_bits=bits).collect()
    assert sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["kept"]) for r in got) == want


@pytest.mark.parametrize("bits", [1 << 12, 1 << 20, 1 << 22])
def test_bitmap_of_suspects(spark, bits):
    some = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    got = exact_dedup._bitmap(spark.createDataFrame([(x,) for x in some[:1000]], "sha binary").repartition(3), bits)
    at = {int.from_bytes(x[:8], "big") >> (64 - bits.bit_length() + 1) for x in some[:1000]}
    assert len(got) * 8 == bits and np.flatnonzero(np.unpackbits(np.frombuffer(got, np.uint8))).tolist() == sorted(at)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_roots(edges):
    a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    got = graph.roots(a, b, 31)
    assert got.tolist() == by_hand(range(31), edges)


def by_hand(nodes, edges):
    label = {n: n for n in nodes}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return [label[n] for n in nodes]


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL_EDGES", small)
    rng = random.Random(5)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 6000 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    want = dict(zip(nodes, by_hand(nodes, [e for e in edges if e[0] != e[1]])))
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out, i = [], 0
    for _ in range(14):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = [rng.choice(vocab) if rng.random() < 0.012 else w for w in base]
            out.append((i, " ".join(copy).replace("w1 ", "W1\t")))
            i += 1
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    out += [(i + k, passage + " " + " ".join(rng.choice(vocab) for _ in range(k))) for k in range(25)]
    return out + [(9000, ""), (9001, None), (9002, " \n"), (9003, "one two"), (9004, "One  two"), (9005, "one"), (9006, passage), (9006, "one two"), (None, passage)]


def sets_of(text, k):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(words[j : j + k]) for j in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)]) if words else frozenset()


def brute(texts, k, percent):
    sets = [sets_of(t, k) if i is not None else frozenset() for i, t in texts]
    linked = [[b for b in range(len(sets)) if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])] for a in range(len(sets))]
    out = []
    for a, (i, t) in enumerate(texts):
        seen, line = {a}, [a]
        while line:
            for b in linked[line.pop()]:
                if b not in seen:
                    seen.add(b)
                    line.append(b)
        out.append((repr(i), len(sets_of(t, k)), repr(min((texts[b][0] for b in seen if texts[b][0] is not None), default=None)), len(linked[a])))
    return sorted(out)


@pytest.mark.parametrize(("k", "percent", "most", "bits"), [(4, 85, None, None), (5, 80, None, 64), (4, 85, 500, None), (4, 85, 500, 20)])
def test_near_duplicates(spark, monkeypatch, k, percent, most, bits):
    if most:
        monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", most), monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    if bits == 64:
        monkeypatch.setattr(ngram_join, "MOST_BITS", bits)
    elif bits:
        monkeypatch.setattr(ngram_join, "BITMAP_SHINGLES", bits)
    texts = corpus()
    got = ngram_join.near_duplicates(frame(spark, texts).repartition(3), k, percent).collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"]), r["n_links"]) for r in got) == brute(texts, k, percent)


def test_links_of_fewer_sets_than_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", 500)
    rng, texts = random.Random(8), []
    for g in range(20):
        base = [f"g{g}v{rng.randint(0, 10**6)}" for _ in range(300)]
        texts += [(3 * g + k, " ".join(base + [f"end{k}"])) for k in range(3)]
    got = ngram_join.near_duplicates(frame(spark, texts), 4, 85).collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"]), r["n_links"]) for r in got) == brute(texts, 4, 85)


def test_postings_of_long_texts_grow_with_their_length(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(60_000)]
    texts = [(1, " ".join(words)), (2, " ".join(words[:-50])), (3, " ".join(words[30_000:]))]
    for k, percent in ((4, 85), (5, 80)):
        got = ngram_join.near_duplicates(frame(spark, texts), k, percent).collect()
        assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]
    assert all(ngram_join.parity(np.arange(n, dtype=np.uint64) << np.uint64(40)).nbytes <= ngram_join.MOST_BITS // 8 for n in (1, 2, 3000, 5000, 32_768, 60_000))


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.near_duplicates(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, 0)]


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 1 << 60), min_size=1, max_size=300), st.sets(st.integers(0, 1 << 60), max_size=60))
def test_parity_bounds_the_difference(a, more):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, a ^ more if a ^ more else a))
    p, q = (ngram_join.parity(v)[None] for v in (x, y))
    while p.shape[1] != q.shape[1]:
        p, q = (ngram_join.folded(v) if v.shape[1] == max(p.shape[1], q.shape[1]) else v for v in (p, q))
    assert np.bitwise_count(p ^ q).sum() <= len(set(x.tolist()) ^ set(y.tolist()))
