"""Each registered record query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tessel import crawl_queries, queries, stream_queries  # noqa: F401  (the others add their queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(items):
    return sorted(repr(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in r.items())) for r in items)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toArrow().to_pylist()
    if name in queries.SQL:
        rel = con.sql(queries.SQL[name])
        assert rows(got) == rows(rel.to_arrow_table().to_pylist())
    else:
        assert got


def test_link_title_pairs_read_whole_texts(spark, tmp_path):
    said = [(3, "word " * 30 + "end"), (7, "one\n" + "two " * 20 + "three"), (11, None), (15, "one\n")]
    spark.createDataFrame(said, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["url"], r["title"]) for r in queries.link_title_pairs(spark, str(tmp_path)).collect()}
    assert got == {i: (f"https://pan.quark.cn/s/q{i}", t.split("\n")[-1]) for i, t in said if t and i != 15}


def test_sort_by_name_of_any_letters(spark, tmp_path):
    names = ["b", "B", "a", "é", "e", "ez", "éa", "中", "一", "", None, "Z z", "a"]
    spark.createDataFrame([(i, t, "x" if i % 5 else None) for i, t in enumerate(names)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["rank"] for r in queries.sort_by_name_zh(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW d AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.sql("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY coalesce(text, '') COLLATE zh, doc_id) FROM d").fetchall())
