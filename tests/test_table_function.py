"""The polymorphic table function of search."""

import pytest
from pyspark.sql.types import Row

from tessel.sources import table_function


@pytest.fixture(scope="module")
def view(spark):
    table_function.register(spark)
    links = [Row(type="quark", url=f"https://pan.quark.cn/s/{k}", password=None) for k in range(2)]
    rows = [(f"s{k % 3}-{k}", f"s{k % 3}", "Alpha Beta" if k % 2 else None, "gamma" if k % 3 else "delta beta", links if k % 4 else [], k) for k in range(24)]
    spark.createDataFrame(rows, "unique_id string, source string, title string, content string, links array<struct<type:string,url:string,password:string>>, rank int").repartition(5).createOrReplaceTempView("some")
    return rows


def run(spark, keyword, options=None):
    more = f", '{options}'" if options is not None else ""
    return spark.sql(f"SELECT * FROM search_records(TABLE(some), '{keyword}'{more})")


def test_options_change_columns_and_rows(spark, view):
    plain = run(spark, "ALPHA gamma")
    assert plain.columns == ["unique_id", "title"] and {r[0] for r in plain.collect()} == {r[0] for r in view if r[5] % 2 and r[5] % 3}
    linked = run(spark, "alpha gamma", '{"links": true, "content": true}')
    assert linked.columns == ["unique_id", "title", "content", "link_type", "link_url", "link_password"]
    assert linked.count() == 2 * sum(1 for r in view if r[5] % 2 and r[5] % 3 and r[4])
    assert run(spark, "nothing", '{"skip": true}').count() == 24
    assert run(spark, "nothing", '{"title_en": "Delta"}').count() == 8
    assert run(spark, "").count() == 24


def test_a_limit_deals_rows_by_source(spark, view):
    got = run(spark, "beta", '{"limit": 2, "position": true, "order": "rank"}')
    assert got.columns == ["unique_id", "title", "position"]
    want = set()
    for s in range(3):
        mine = sorted(r[5] for r in view if r[1] == f"s{s}" and (r[5] % 2 or r[5] % 3 == 0))[:2]
        want |= {(f"s{s}-{k}", place) for place, k in enumerate(mine, 1)}
    assert {(r["unique_id"], r["position"]) for r in got.collect()} == want
    assert run(spark, "beta", '{"limit": 1, "by": "rank"}').count() == sum(1 for r in view if r[5] % 2 or r[5] % 3 == 0)


@pytest.mark.parametrize("options", ["[]", "{", '{"x": 1}', '{"limit": 0}', '{"limit": "2"}', '{"links": 1}', '{"limit": 1, "by": "none"}'])
def test_wrong_options_are_told_when_the_query_is_made(spark, view, options):
    with pytest.raises(Exception, match="option|column|JSON|no column"):
        run(spark, "x", options)


def test_a_table_is_needed(spark, view):
    with pytest.raises(Exception, match="TABLE"):
        spark.sql("SELECT * FROM search_records(1, 'x')")


def test_beside_each_row(spark):
    spark.createDataFrame([(1, "bb a bb CCC"), (2, None), (3, "")], "k int, term string").createOrReplaceTempView("more")
    got = spark.sql("SELECT k, word, place FROM more, LATERAL search_variants(term)").collect()
    assert sorted(map(tuple, got)) == [(1, "a", 3), (1, "bb", 2), (1, "ccc", 1)]
