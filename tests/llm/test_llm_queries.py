"""The registered queries against their SQL, and the pipeline stage by stage against plain Python."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import queries
from tessel.llm.common import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(items):
    return sorted(repr(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in r.items())) for r in items)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toArrow().to_pylist()) == rows(con.sql(queries.SQL[name]).to_arrow_table().to_pylist())


@pytest.mark.parametrize(("name", "n"), [("op8_langid", 4), ("op4_toxicity", 5)])
def test_one_row_a_document_and_held_out(spark, name, n):
    got = queries.QUERIES[name](spark, SF).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"] for r in got} == ids and len(got) == len(ids)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == (2 if n == 4 else 0)) and 0 <= r["score"] <= 1 for r in got)


def test_language_of_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in queries.QUERIES["op8_langid"](spark, SF).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.95 * len(got) > 0


def shingled(text, k):
    w = text.lower().split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {" ".join(w)} if w else set()


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF), f"test-{k}")
        if k < 4:
            assert docs.columns == columns
            seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
            assert docs.count() == len(seen[-1])
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert not clean - set(seen[1]) and set(seen[0]) - set(seen[1]) <= toxic | (set(seen[0]) - clean)
    last = {}
    for i, t in seen[1].items():
        last[t] = max(i, last.get(t, i))
    assert set(seen[2]) == set(last.values())
    sets = {i: shingled(t, 5) for i, t in seen[2].items()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert set(seen[3]) == {i for i in sets if top(i) == i} and seen[4] == seen[3]
    assert {r["doc_id"] for r in docs.collect()} == set(seen[4])


def test_pipeline_follows_the_mixture(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 20).alias("source"), F.lit(3).alias("n_chars"))
    mixed = stored(corpus_pipeline.mix_sources(spark, docs, SF), "test-mixed")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    got = sorted((r["slot"], r["place"], r["doc_id"]) for r in corpus_pipeline.encode(spark, mixed, SF).collect())
    assert len({(slot, place) for slot, place, _ in got}) == len(got) == 6000
    total, had, of_slot = sum(queries.MIXTURE.values()), Counter(), {slot: source[i] for slot, _, i in got}
    for slot in range(38):  # no source has run out
        had[of_slot[slot]] += 1
        assert all(abs(had[s] - w * (slot + 1) / total) < 1 for s, w in queries.MIXTURE.items())
    assert [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()] == [i for _, _, i in got]


def test_pipeline_of_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    said = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 500)) for _ in range(n))
    near, long, twice = said(60), said(20_000), said(40)
    rows = [(1, None), (2, ""), (3, near), (None, near + " x"), (4, near + " y z"), (None, "alone"), (None, "alone"), (5, "alone two"), (6, "same"), (None, "same"), (7, "same"), (7, "same"),
            (8, twice), (8, said(40)), (9, twice), (10, long), (11, long + " end"), (None, None), (12, near + " y z")]
    docs = spark.createDataFrame([(i, t, None, "src1" if i is None or i % 2 else None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = docs
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen = stored(stage(spark, seen, str(tmp_path)), f"odd-{k}")
        kept.append(sorted(((r["doc_id"], r["text"]) if k < 4 else (r["doc_id"], r["decoded_sha256"]) for r in seen.collect()), key=repr))
    assert kept[0] == sorted(rows, key=repr)
    largest = {}
    for i, t in rows:
        largest[t or ""] = max((x for x in (i, largest.get(t or "")) if x is not None), default=None)
    assert sorted(((i, t or "") for i, t in kept[1]), key=repr) == sorted(((i, t) for t, i in largest.items()), key=repr)
    other = next(t for i, t in rows if i == 8 and t != twice)
    want = [(2, ""), (3, near), (None, "alone"), (5, "alone two"), (7, "same"), (9, twice), (8, other), (10, long)]
    assert sorted(((i, t or "") for i, t in kept[2]), key=repr) == sorted(want, key=repr) and kept[3] == kept[2]
    assert kept[4] == sorted(((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in kept[2]), key=repr)
    assert all(r["slot"] is not None for r in seen.collect())


def by_library(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary_path())
    for t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        yield len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_encodes_as_the_library_and_places_as_the_schedule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.encode(spark, docs, SF).collect()}
    assert [(got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) for i in rows] == list(by_library(r["text"] for r in rows.values()))
    weights = {s: Fraction(w, sum(queries.MIXTURE.values())) for s, w in queries.MIXTURE.items()}
    mine = {s: sorted((i for i, r in rows.items() if r["source"] == s), key=lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i)) for s in weights}
    left, done, slot, want = {s: -(-len(x) // 64) for s, x in mine.items()}, dict.fromkeys(weights, 0), 0, {}
    while any(left.values()):  # earliest deadline first, by hand
        ready = [(math.ceil((done[s] + 1) / w), s) for s, w in sorted(weights.items()) if left[s] and math.floor(done[s] / w) <= slot]
        if ready:
            s = min(ready)[1]
            want |= {i: (slot, place) for place, i in enumerate(mine[s][64 * done[s] : 64 * done[s] + 64])}
            done[s], left[s] = done[s] + 1, left[s] - 1
        slot += 1
    shifted = sorted(set(at[0] for at in want.values()))
    assert sorted(got, key=lambda i: (got[i]["slot"], got[i]["place"])) == sorted(want, key=lambda i: want[i]) and len(shifted) == len({r["slot"] for r in got.values()})


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
