import hashlib
import json
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.llm import bpe, chat, html_text, langid, mixing, nearest, sharding, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCAB = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokens():
    from tokenizers import Tokenizer

    with open(VOCAB, encoding="utf-8") as f:
        return Tokenizer.from_file(VOCAB), bpe.Bpe.from_json(f.read())


ODD = "ab thé ñß's 'll  \n\t\r\x85\xa0\u2003\u3000\x1c٣²Ⅷ中日本𝒳👍🏽!?.,-_$0\u200b\x00"


def bpe_by_library(lib, text):
    ids = lib.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def bpe_digests(w, texts):
    n, ids, back = w.digest(pa.array(texts, pa.string()))
    return list(zip(n.tolist(), ids, back))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(ODD), max_size=60) | st.text(max_size=40) | st.just("x <|endoftext|>\n y"), min_size=1, max_size=4))
def test_bpe_equals_the_library(tokens, texts):
    lib, own = tokens
    w = bpe.Worker(own)
    assert [x.tolist() for x in w.ids(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe_digests(w, texts) == bpe_digests(w, texts) == [bpe_by_library(lib, t) for t in texts]


def test_bpe_forgets_by_bytes(tokens):
    lib, own = tokens
    w, rng = bpe.Worker(own), random.Random(5)
    w.store.most = 20_000
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(4)]
        assert bpe_digests(w, texts) == [bpe_by_library(lib, t) for t in texts]
    assert 0 < len(w.store.at) < 400


def test_bpe_of_one_long_word(tokens):
    lib, own = tokens
    rng = random.Random(6)
    began = time.perf_counter()
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 200_000), ("a", 50_000), ("中é", 20_000), ("!?", 30_000)):
        word = "".join(rng.choice(letters) for _ in range(n))
        assert own.encode_words([word])[0].tolist() == lib.encode(word, add_special_tokens=False).ids
    assert time.perf_counter() - began < 20


def test_bpe_frames(spark, tokens):
    texts = [(1, "Hello world<|endoftext|>  x"), (2, None), (3, ""), (3, ""), (4, "ab " * 50_000), (None, "a" * 5_000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, ids int")
    ids = bpe.encode(docs, VOCAB)
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in ids.collect()) == sorted((repr(i), tokens[0].encode(t or "", add_special_tokens=False).ids) for i, t in texts)
    assert sorted((repr(r["doc_id"]), r["text"]) for r in bpe.decode(ids, VOCAB).collect()) == sorted((repr(i), t or "") for i, t in texts)
    got = bpe.round_trip(docs, VOCAB).collect()
    assert sorted((repr(r["doc_id"]), r["decoded_sha256"]) for r in got) == sorted((repr(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    assert bpe.round_trip(docs.limit(0), VOCAB).count() == 0


def vectors():
    rng = np.random.default_rng(4)
    out = [(i, [float(np.float32(v)) for v in rng.normal(size=8)]) for i in range(300)]
    out += [(300 + i, out[i % 5][1]) for i in range(20)]  # ties
    out += [(400, None), (500, [0.0] * 8), (600, [float("nan")] + [1.0] * 7), (700, [float("inf")] + [1.0] * 7), (800, [None] + [1.0] * 7), (900, [1.0, 2.0]), (901, [1.0, 3.0]), (1000, []), (None, [1.0] * 8), (200, out[200][1]), (1100, [1e-30] * 8)]
    return out


@pytest.mark.parametrize("most", [1 << 20, 100])
def test_nearest_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(nearest, "QUERY_BYTES", most), monkeypatch.setattr(nearest, "BLOCK_ROWS", 60)
    rows = vectors()
    df = spark.createDataFrame([(i, x, 1, "q") for i, x in rows], "vec_id long, embedding array<float>, rank int, query_id string").repartition(4)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.nearest(df, F.col("vec_id") % 100 == 0, 10).collect())
    good = {i: np.array(x, np.float32).astype(float) for i, x in rows if i is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)}
    want = []
    for q in sorted(good):
        if q % 100 == 0:
            near = sorted((float(nearest.exactly(good[q][None], x[None])[0]), i) for i, x in good.items() if i != q and len(x) == len(good[q]))
            want += [(q, k + 1, i, d) for k, (d, i) in enumerate(near[:10])]
    assert got == want


def test_nearest_of_nothing(spark):
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


def test_schedule_keeps_every_window():
    parts = mixing.shares({"a": 1, "b": 2.5, "c": 0.01, "d": 7, None: 3}, 1024)
    assert sum(parts.values()) == 1024
    plan = mixing.schedule(parts, 1024)
    assert sorted(p[2] for p in plan) == list(range(1024)) and all(release <= slot < due for _, _, slot, release, due in plan)
    had = Counter()
    for t, (s, *_) in enumerate(sorted(plan, key=lambda p: p[2])):
        had[s] += 1
        assert all(abs(had[x] - parts[x] * (t + 1) / 1024) < 1 for x in parts)


@pytest.mark.parametrize("weights", [{"a": 0.1, "b": 0.2, "c": 0.7}, dict.fromkeys("abcde", 1), dict.fromkeys("abcdefg", 1), {"a": 3, "b": 1, "c": 1, "d": 2}])
def test_schedule_is_pfair_over_ten_periods(weights):
    period, parts, plan = mixing.planned(weights)
    target = {s: w / sum(weights.values()) for s, w in weights.items()}
    slots = sorted((slot + turn * period, s) for turn in range(10) for s, _, slot, _, _ in plan)
    assert [slot for slot, _ in slots] == list(range(10 * period))
    had = Counter()
    for slot, s in slots:
        had[s] += 1
        assert all(abs(had[x] - target[x] * (slot + 1)) < 1 - 1e-9 for x in target)


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 0.31831, "c": 0.0001}])
def test_mixing_meets_targets_over_many_periods(spark, weights):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("source"))
    target = {s: w / sum((weights or {"a": 1, "b": 1, "c": 1}).values()) for s, w in (weights or {"a": 1, "b": 1, "c": 1}).items()}
    got = sorted((r["slot"], r["source"], r["block"], r["release"], r["deadline"]) for r in mixing.mix(docs, weights, block_rows=1).collect())
    assert len({r[0] for r in got}) == 9000 and all(release <= slot < due for slot, _, _, release, due in got)
    first_out = min(max(r[0] for r in got if r[1] == s) for s in "abc")
    had, n = Counter(), 0
    for slot, s, block, release, due in got:
        assert abs(release - block / target[s]) <= 1.001 and abs(due - (block + 1) / target[s]) <= 1.001
        had[s] += 1
        if slot <= first_out:
            n += 1
            assert slot == n - 1 and all(abs(had[x] - target[x] * (slot + 1)) < 1 for x in target)
    assert n > 3000


def test_mixing_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20), monkeypatch.setattr(mixing, "REPEATS", 16)
    rows = [(None, None)] * 70 + [(4, "s4")] * 40 + [(i, "hot" if i % 3 == 0 else f"s{i % 7}" if i % 50 else None) for i in range(500)] + [(None, "hot"), (3, "hot"), (3, "hot")]
    docs = spark.createDataFrame([(i, s, 0, 0) for i, s in rows], "doc_id long, source string, slot int, block int")
    got = mixing.mix(docs, {"hot": 2.0, "s1": 1.0}, block_rows=4).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows)
    assert len({(r["slot"], r["place"]) for r in got}) == len(rows) and all(r["release"] <= r["slot"] < r["deadline"] and r["place"] < 4 for r in got)
    for s in {s for _, s in rows}:
        mine = sorted((r["block"], r["place"]) for r in got if r["source"] == s)
        assert mine == [(k // 4, k % 4) for k in range(len(mine))]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_lookup_table_is_even_and_moves_little():
    shards = [f"s{k}" for k in range(20)]
    table = sharding.fill(shards, 5003)
    n = Counter(table)
    assert max(n.values()) - min(n.values()) <= 1 and len(n) == 20
    fewer = sharding.fill(shards[:-1], 5003)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved < 0.1 * 5003
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, 5003)
    with pytest.raises(ValueError):
        sharding.fill(shards, 5000)


def test_sharding_rows(spark):
    shards = ["a", "b", "c"]
    docs = spark.createDataFrame([(i, "k" if i % 2 else str(i), 1) for i in range(400)] + [(None, None, 2), (7, "k", 3), (7, "k", 3)], "doc_id long, key string, shard int")
    table = sharding.fill(shards, 307)
    got = sharding.place(docs, shards, size=307).collect()
    want = [table[int(hashlib.md5(b"" if i is None else str(i).encode()).hexdigest()[:8], 16) % 307] for i in (r["doc_id"] for r in got)]
    assert [r["shard"] for r in got] == [shards[k] for k in want] and len(got) == 403
    spread = Counter(r["shard"] for r in sharding.place_hot(docs, shards, "key", "doc_id", 20, 307).where("key = 'k'").collect())
    assert len(spread) == 3 and sum(spread.values()) == 202


def test_sharding_of_odd_tables(spark):
    shards = ["a", "b", "c"]
    rows = [("x" * 200_000, 1, 1, 1, "u"), ("", 2, 2, 2, "v"), (None, 3, 3, 3, "w")]
    docs = spark.createDataFrame(rows, "key string, hot_n int, hot_key int, slot int, k string")
    got = sharding.place(docs, shards, "key", 307)
    assert sorted(got.columns) == sorted([*docs.columns, "shard"]) and got.count() == 3 and sharding.place(docs.limit(0), shards, "key", 307).count() == 0
    at = {r["k"]: r["slot"] for r in got.collect()}
    assert at["v"] == at["w"] and at["u"] == int(hashlib.md5(b"x" * 200_000).hexdigest()[:8], 16) % 307
    hot = sharding.place_hot(docs, shards, "key", "k", 1, 307)
    assert sorted(hot.columns) == sorted([*docs.columns, "shard"]) and hot.count() == 3 and sharding.place_hot(docs.limit(0), shards, "key", "k", 1, 307).count() == 0


@given(st.text(st.sampled_from("\\<s>/[INST] SYSROLE\nx"), max_size=40) | st.text(max_size=30), st.sampled_from(["user", "assistant", "system", "tool", "", "a]b\n"]))
def test_chat_turns_come_back(text, role):
    piece, a, b = chat.formatted(role, text)
    assert list(chat.parsed(piece + piece)) == [(role, text)] * 2
    assert chat.unescape(piece[a:b]) == (text if role == "assistant" else "")


RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations", [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "input": "c", "output": "b"}, "instruction", [("user", "a\n\nc"), ("assistant", "b")]),
    ({"system": "s", "prompt": "a", "completion": "b"}, "prompt-completion", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ({"context": "c", "question": "a", "answer": "b"}, "question-answer", [("user", "c\n\na"), ("assistant", "b")]),
    ({"odd": 1}, "unknown", []),
]


def test_chat_records(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(90, None), (91, "no json"), (92, "[1]")]
    got = {r["conv_id"]: r for r in chat.format_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert (got[i]["layout"], list(chat.parsed(got[i]["formatted"]))) == (layout, turns)
        assert [got[i]["formatted"][s["begin"] : s["end"]] for s in got[i]["loss_spans"]] == [t for r, t in turns if r == "assistant"]
    assert all(got[i]["layout"] == "unknown" for i in (90, 91, 92))
    assert len({chat.fingerprint(chat.paths(r)) for r, _, _ in RECORDS}) == len(RECORDS)


def test_odd_records_are_no_errors(spark):
    odd = ['{"messages": ["hi"]}', '{"messages": [null, {"role": "user", "content": "a"}]}', '{"conversations": [1]}', '{"instruction": "a", "output": 5}',
           '{"instruction": "a", "input": ["x"], "output": "b"}', '{"messages": {"role": "user", "content": "a"}}', '{"messages": []}', "[" * 5000, '{"a": ' * 3000 + "1" + "}" * 3000,
           '{"prompt": null, "completion": {"a": 1}}', '{"messages": [{"role": 3, "content": ["a"]}]}', "", "{}", None, "1"]
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(odd)], "conv_id long, record string, layout string")
    got = {r["conv_id"]: (r["layout"], list(chat.parsed(r["formatted"]))) for r in chat.format_records(df).collect()}
    want = {3: ("instruction", [("user", "a"), ("assistant", "5")]), 4: ("instruction", [("user", 'a\n\n["x"]'), ("assistant", "b")]), 6: ("messages", []),
            9: ("prompt-completion", [("user", ""), ("assistant", '{"a": 1}')]), 10: ("messages", [("3", '["a"]')])}
    assert got == {i: want.get(i, ("unknown", [])) for i in range(len(odd))}
    assert chat.format_records(df.limit(0)).count() == 0


def test_masks_are_read_from_the_template():
    turns = [("user", "a </s> b"), ("assistant", "x [INST] \\"), ("system", ""), ("assistant", ""), ("tool", "]"), ("assistant", "y" * 10_000)]
    whole = "".join(chat.formatted(r, t)[0] for r, t in turns)
    for size in (1, 7, 100_000):
        reader = chat.Reader()
        got = [x for a in range(0, len(whole), size) for x in reader.feed(whole[a : a + size])] if size > 1 or len(whole) < 500 else None
        if got is not None:
            reader.close()
            assert [(r, t) for r, t, _ in got] == turns and [m for r, _, m in got] == [chat.escape(t) if r == "assistant" else "" for r, t in turns]
    with pytest.raises(ValueError):
        list(chat.parsed(whole[:-1]))


def test_chat_turn_tables(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "q"), (1, 1, "assistant", "z"), (None, 0, "user", "n"), (2, None, "user", "x"), (2, None, "user", "x")]
    table = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.turn_rows(table))).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {None: 1, 1: 3, 2: 2}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nq\nassistant\n\nassistant\nz\n").hexdigest() and got[1]["loss_chars"] == 1
    with pytest.raises(ValueError):
        chat.turn_rows(spark.range(1))


@pytest.fixture(scope="module")
def crf():
    return html_text.train(pages=200, steps=80)


def test_html_blocks():
    page = "<!-- x --><script>var t='</p>';</script><p>a&nbsp;&amp;\n b<br>c<p>d<b>e</b><div class='Ad box'>f</div>"
    assert [(b.text, b.node.tag) for b in html_text.blocks(page)] == [("a & b c", "p"), ("de", "p"), ("f", "div")]
    assert html_text.blocks(page)[2].node.names == {"ad", "box"}
    assert html_text.blocks("") == [] and html_text.blocks("<p") != None  # noqa: E711


def test_html_accuracy(crf):
    rng, wrong, total = random.Random(77), 0, 0
    for _ in range(150):
        page, labels = html_text.labelled_page(rng)
        got = crf.decode(html_text.features(html_text.blocks(page)))
        assert len(got) == len(labels)
        wrong, total = wrong + sum(a != b for a, b in zip(got, labels)), total + len(labels)
    assert wrong < 0.02 * total


def test_viterbi_finds_the_best_chain(crf):
    page, _ = html_text.labelled_page(random.Random(5))
    chain = html_text.features(html_text.blocks(page))[:8]
    emit = [sum((crf.emit[crf.number[f]] for f in x if f in crf.number), np.zeros(2)) for x in chain]

    def score(states):
        return crf.start[states[0]] + crf.end[states[-1]] + sum(e[s] for e, s in zip(emit, states)) + sum(crf.step[a, b] for a, b in zip(states, states[1:]))

    best = max((tuple(int(c) for c in f"{k:0{len(chain)}b}") for k in range(1 << len(chain))), key=score)
    assert [int(x) for x in crf.decode(chain)] == list(best)


def test_html_pages(spark, crf):
    page = "<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><article><h1>Head line</h1><p>First, a sentence.</p><p>And another one.</p></article><footer>&copy; me</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", page, "x"), (4, "u", "<article><p>" + "long text, and more. " * 20_000, "x")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df, crf).collect())
    main = "Head line\n\nFirst, a sentence.\n\nAnd another one."
    assert got[:4] == [(1, main, len(main)), (1, main, len(main)), (2, "", 0), (3, "", 0)] and got[4][2] == 20_000 * 21 - 1
    assert html_text.extract(df.limit(0), crf).count() == 0


def test_automaton_knows_all_substrings():
    rng = random.Random(2)
    s = [rng.randint(2, 4) for _ in range(60)]
    table = langid.Automaton(s, 5).table
    parts = {tuple(s[a:b]) for a in range(60) for b in range(a + 1, 61)}
    for _ in range(500):
        x = tuple(rng.randint(2, 4) for _ in range(rng.randint(1, 7)))
        at = 1
        for c in x:
            at = table[at, c]
        assert (at > 0) == (x in parts)


def test_phrases_are_the_greedy_parse(monkeypatch):
    p = langid.Parser({"a": "the cat sat on the mat", "b": "der hund lag auf der matte"})
    for text in ("the hat on the cat", "auf und ab", "x", "", "zzz the"):
        x = p.read(text)
        for k, lang in enumerate(p.langs):
            ref = p.read({"a": "the cat sat on the mat", "b": "der hund lag auf der matte"}[lang]).tobytes()
            n, i = 0, 0
            while i < len(x):
                j = i + 1
                while j < len(x) and x[i : j + 1].tobytes() in ref:
                    j += 1
                n, i = n + 1, j
            assert p.phrases([x])[0, k] == n


@pytest.mark.parametrize("bounds", [(8, 3, 50), (16, 16, 1 << 20), (1024, 256, 1 << 20), (1024, 256, 2000)])
def test_segments_and_parts_change_nothing(monkeypatch, bounds):
    rng = random.Random(8)
    said = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"a": said("ab c", 400), "b": said("abd ", 400), "c": said("a", 300) + said("abcd ", 60)}
    p = langid.Parser(samples)
    texts = [said("abcdé ", n) for n in (0, 1, 7, 8, 9, 50, 51, 300, 1024, 5000)] + ["a" * 900, said("ab", 200) + "a" * 400]
    want = [[greedy(p.read(t).tobytes(), p.read(samples[lang]).tobytes()) for lang in p.langs] for t in texts]
    monkeypatch.setattr(langid, "SEGMENT", bounds[0]), monkeypatch.setattr(langid, "TRACE", bounds[1]), monkeypatch.setattr(langid, "PART", bounds[2])
    assert p.phrases([p.read(t) for t in texts]).tolist() == want


def greedy(x, ref):
    n, i = 0, 0
    while i < len(x):
        j = i + 1
        while j < len(x) and x[i : j + 1] in ref:
            j += 1
        n, i = n + 1, j
    return n


def test_every_letter_counts():
    rng = random.Random(6)
    han = [chr(0x4E00 + k) for k in range(600)]
    words = ["".join(rng.choice(han) for _ in range(2)) for _ in range(120)], ["".join(rng.choice(han) for _ in range(2)) for _ in range(120)]
    said = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    samples = {"ja": said(0, 900), "zh": said(1, 900), "en": "the cat sat on the mat", "ko": "".join(chr(0xAC00 + k) for k in range(200))}
    p = langid.Parser(samples)
    assert p.n_classes > 256
    for text in (said(0, 40), said(1, 40), "cat " + said(0, 5) + "乀龥 x"):
        x = p.read(text)
        for k, lang in enumerate(p.langs):
            ref, n, i = p.read(samples[lang]).tolist(), 0, 0
            grams = [{tuple(ref[a : a + size]) for a in range(len(ref) - size + 1)} for size in range(len(x) + 1)]
            while i < len(x):
                j = i + 1
                while j < len(x) and tuple(x[i : j + 1].tolist()) in grams[j + 1 - i]:
                    j += 1
                n, i = n + 1, j
            assert p.phrases([x])[0, k] == n
    assert p.predict([said(0, 30) for _ in range(20)] + [said(1, 30) for _ in range(20)])[0] == ["ja"] * 20 + ["zh"] * 20


def test_language_samples_reach_all_of_a_text(spark):
    head = "all rights reserved by the makers of this page " * 12
    said = {"de": "der hund lag auf der matte ", "en": "the cat sat on the mat "}
    docs = spark.createDataFrame([(i, head + f"row{chr(97 + i // 26)}{chr(97 + i % 26)} " + said[lang] * 60, lang) for i, lang in enumerate(["de", "en"] * 90)], "doc_id long, text string, lang string")
    got = langid.samples(docs, F.lit(True))
    assert all(langid.SAMPLE_CHARS - 200 <= len(x) <= langid.SAMPLE_CHARS for x in got.values())
    assert got["de"].count("hund") > 100 and got["en"].count("cat") > 100
    assert all(r["lang_pred"] == r["lang"] for r in langid.identify(docs, F.lit(True)).join(docs, "doc_id").collect())
    one = langid.samples(docs.limit(1), F.lit(True))
    assert sum(len(x) for x in one.values()) > 1500


def test_language_rows(spark):
    en, de = "the cat sat on the mat and looked at the other cats", "der hund lag auf der matte und sah die anderen hunde an"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", 1) for i in range(40)] + [(50, None, "en", 1), (51, "12 !?", "en", 1), (52, "", None, 1), (53, "the mat " * 30_000, None, 1), (54, "auf der matte", None, 1), (54, "auf der matte", None, 1), (55, "中文", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = Counter((r["doc_id"], r["lang_pred"]) for r in langid.identify(df, F.lit(True)).collect() if r["doc_id"] >= 50)
    assert got[(50, "und")] == got[(51, "und")] == got[(52, "und")] == 1 and got[(53, "en")] == 1 and got[(54, "de")] == 2 and sum(got.values()) == 7
    assert {r["lang_pred"] for r in langid.identify(df, F.lit(False)).collect()} == {"und"}
    assert langid.identify(df.limit(0), F.lit(True)).count() == 0


def toxic_rows(n=600, seed=3):
    rng = random.Random(seed)
    vocab, bad = [f"word{i}" for i in range(200)], ["vilething", "nastyone", "scumlike"]
    out = []
    for i in range(n):
        words, toxic = [rng.choice(vocab) for _ in range(30)], i % 6 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(bad) + rng.choice(["", "s"])
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows] + [(9000, None, 0.0), (9001, "", 0.0), (9002, "word1 " * 50_000 + "nastyone", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if i % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert got[9000]["predicted"] == got[9001]["predicted"] == 0 and got[9002]["predicted"] == 1 and len(got) == len(rows) + 3
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r["predicted"]}


def test_strong_terms_survive_a_few_clean_rows(spark):
    rows = [(i, t + " nastyone" if i in (7, 8) else t, y) for i, t, y in toxic_rows()]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, "word1 word2 nastyone word3"), (9001, "word1 word2 word3")], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), F.col("doc_id") % 5 != 0)
    assert (0, "nastyone") in model.lexicon.terms
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).where("doc_id >= 9000").collect()} == {9000: 1, 9001: 0}


def test_toxicity_without_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(round(r["score"], 3), r["predicted"]) for r in toxicity.score(docs, toxicity.learn(docs, none, F.lit(True))).collect()} == {(0.0, 0)}
    assert toxicity.keep_clean(docs, toxicity.learn(docs, none, F.lit(True))).count() == 2
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, one, F.lit(True))).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), one, F.lit(True))).count() == 0


def test_label_model_discounts_repeated_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    a, b = (np.where(rng.random(4000) < 0.8, y, ~y) for _ in range(2))
    votes = np.stack([a, a, a, b], axis=1).astype(float)
    p, weight = toxicity.label_model(votes, 0.3, 0.1 + 0.8 * b)
    assert weight[:3].max() < 0.5 < weight[3] and ((p > 0.5) == y).mean() > 0.78


def test_label_model_beats_the_majority():
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.4
    voters = [np.where(rng.random(6000) < right, y, ~y) for right in (0.9, 0.6, 0.6, 0.55, 0.55)]
    votes = np.stack(voters, axis=1).astype(float)  # independent; copies of a weak voter can mislead the model
    start = np.where(rng.random(6000) < 0.8, y, ~y) * 0.8 + 0.1  # labels, one in five of them wrong
    p, _ = toxicity.label_model(votes, 0.4, start, 6)
    right = ((p > 0.5) == y).mean()
    majority, labels = ((votes.mean(axis=1) > 0.5) == y).mean(), ((start > 0.5) == y).mean()
    assert right > labels + 0.03 and right > majority + 0.03
