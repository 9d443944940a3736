"""Tokens, selectors and elements of pages."""

import time

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel import crawl_queries, queries
from tessel.functions import html


def found(page, root=None, **rules):
    return [[(e["rule"], e["text"]) for e in inside] for _, inside in html.matched(page, html.Rules(rules), root)]


def one(page, selector):
    return [t for _, t in found(page, x=selector)[0]]


def test_compounds_and_combinators():
    page = '<div class="a b" id="i"><p>1<span class="c">2</span></p><section><p data-x="yes no">3</p></section></div><p>4</p>'
    assert one(page, "p") == ["12", "3", "4"]
    assert one(page, "div p") == ["12", "3"]
    assert one(page, "div > p") == ["12"]
    assert one(page, ".a.b > section p") == ["3"]
    assert one(page, "#i .c, body, section>p") == ["2", "3"]
    assert one(page, "[data-x]") == one(page, "p[data-x~=yes]") == one(page, '[data-x*="s n"]') == one(page, "[data-x^=yes]") == one(page, "[data-x$='no']") == ["3"]
    assert one(page, "[data-x=yes]") == one(page, "span span") == one(page, ".ab") == []
    assert one("<p>x</p>" * 3, "*") == ["x"] * 3
    with pytest.raises(ValueError):
        html.Rules({"x": "a:hover"})


def test_ends_that_are_let_out():
    assert one("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "li") == ["a", "bc", "c", "d"]
    assert one("<p>a<p>b<div>c</div>d", "p") == ["a", "b"]
    assert one("<table><tr><td>a<td>b<tr><td>c</table>d", "td") == ["a", "b", "c"]
    assert one("<table><tr><td>a<td>b<tr><td>c</table>d", "tr") == ["ab", "c"]
    assert one("<dl><dt>a<dd>b<dt>c</dl>", "dt") == ["a", "c"]
    assert one("<select><option>a<option>b</select>", "option") == ["a", "b"]
    assert one("<div><p>a<b>b</div>c", "b") == ["b"]
    assert one("a</p></div><i>b</i>", "i") == ["b"]
    assert one("<td><p>a<table><tr><td>b</table>", "p") == ["a"]


def test_quotes_comments_and_scripts():
    assert one('<p class="a"">x</p>', "p.a") == ["x"]
    assert one("<p class=a title='>'>x</p>", "p.a") == ["x"]
    assert one('<p class = "a" CLASS="b">x', ".a") == ["x"]
    assert one("<p>1 < 2 <3 &lt;&amp;&#233;</p>", "p") == ["1 < 2 <3 <&é"]
    assert one("<!-- <p>no</p> --><p>yes</p><!><!doctype html><?x ?><p>too</p><!--><p>more</p>", "p") == ["yes", "too", "more"]
    assert one("<div>a<script>var x = '<p>no</p></div>';</script><style>p{}</style>b<textarea><p>t</textarea></div>", "div") == ["ab<p>t"]
    assert one("<p>a<script>never ends <p>b", "p") == ["a"]
    assert one("<p>a</p><p b='", "p") == ["a"]
    assert one("<br/><img src=x/><p/>a", "p") == ["a"]
    assert dict(html.matched('<a href="?a=1&amp;b=2">x</a>', html.Rules({"a": "a"}), None)[0][1][0]["attrs"])["href"] == "?a=1&b=2"


def test_nested_roots_have_what_is_inside_them():
    page = '<div class="card"><h3>out</h3><div class="card"><h3>in</h3><a href="x">l</a></div></div><h3>none</h3><div class="card"></div>'
    assert found(page, root="card", card=".card", title="h3", link=".card > a") == [[("title", "out"), ("title", "in"), ("link", "l")], [("title", "in"), ("link", "l")], []]


@pytest.mark.parametrize("piece", ["<a ", '<p x="', "<!--", "<", "</", "<script>", "<title>", "<p", "<div>", "<li><div>", "</b>", "<p a='", "<x y=", "&", "<p><b>", "<table><td>", "<!", "<a href", " =" , "<a =\""])
def test_broken_pages_take_linear_time(piece):
    began = time.perf_counter()
    html.matched(piece * 100_000, html.Rules({"x": "a[href]", "y": "ul > .z"}), None)
    assert time.perf_counter() - began < 6


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<p class=a>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<b>", "x", "<br>", "<", "\"", "<!--", "-->", "<a href='", "'>", "</script>", "<script>"]), max_size=20))
def test_any_page_is_read_to_its_end(pieces):
    page = "".join(pieces)
    for _, inside in html.matched(page, html.Rules({"any": "*", "deep": "div p, ul > li"}), None):
        texts = [e["text"] for e in inside if e["rule"] == "any"]
        assert all(set(t) <= set(page) for t in texts)
    opened = [what for kind, what, _ in html.tokens(page) if kind == "open"]
    assert sum(e["rule"] == "any" for e in inside) == len(opened)


def test_select_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, "<div class=c><a href=u>t</a></div><div class=c></div>", "k"), (2, None, "l"), (3, "", "m")], "id long, html string, more string")
    rows = html.select(pages, "html", {"card": ".c", "a": "a[href]"}, "card")
    got = rows.select("id", "more", "at", F.size("inside").alias("n"), html.text_of("a").alias("t"), html.attr_of("a", "href").alias("h")).collect()
    assert [tuple(r) for r in got] == [(1, "k", 0, 1, "t", "u"), (1, "k", 1, 0, "", "")]
    assert html.select(pages, "html", {"a": "a"}).count() == 3 and html.select(pages.limit(0), "html", {"a": "a"}).count() == 0
    with pytest.raises(ValueError):
        html.select(pages.withColumn("at", F.lit(1)), "html", {"a": "a"})


def test_references_of_rules_as_written():
    page = "<title>a &amp;&lt;&amp</title><p>b &amp;<script>&amp;</script>&lt</p>"
    got = html.matched(page, html.Rules({"title": "title", "p": "p", "q": "p"}), None, written=frozenset({"title", "p"}))
    assert [e["text"] for e in got[0][1]] == ["a &amp;&lt;&amp", "b &amp;&lt", "b &<"]


def test_titles_cut_inside_a_reference_are_those_of_the_sql(spark, tmp_path):
    page = "<html><head><title>{}</title></head><body><nav><ul><li><a href='/'>x</a></ul></nav><article><p>a</p></article></body></html>"
    titles = {1: "the&amp;&amp;&amp", 2: "the&amp;am", 3: " a &lt; b&amp;lt; ", 4: "&am"}
    spark.createDataFrame([(k, page.format(t)) for k, t in titles.items()], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in crawl_queries.page_elements(spark, str(tmp_path)).select("page_id", "title").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT page_id, title FROM ({queries.SQL['page_elements']})").fetchall())
    assert got == want == [(1, "the&&&amp"), (2, "the&am"), (3, "a &lt; b&lt;"), (4, "&am")]


def test_pages_go_to_python_and_on_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        pages = spark.range(0, 3000, 1, 1).select("id", F.concat(F.lit("<p>"), F.col("id").cast("string"), F.lit("</p>")).alias("html"))
        rows = html.select(pages, "html", {"p": "p"})
        sizes = [r["n"] for r in rows.select("id").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
        got = rows.select("id", html.text_of("p").alias("t")).collect()
    finally:
        spark.conf.set(key, before)
    assert sum(sizes) == 3000 and max(sizes) <= 500
    assert [(r["id"], r["t"]) for r in got] == [(k, str(k)) for k in range(3000)]


def test_elements_of_long_pages_are_given_on_together_up_to_a_bound():
    long = "<p>" + "x" * 200_000 + "</p>"
    batch = pa.RecordBatch.from_pydict({"html": [long if k % 2 else "<p>a<p>b" for k in range(30)] + [None, ""], "id": list(range(32))})
    out = list(html.elements(iter([batch, batch.slice(30)]), html.Rules({"p": "p"}), "p", frozenset(), frozenset(), ["id", "at", "root", "inside"]))
    assert max(b.nbytes for b in out) < 2_000_000
    got = [(i, k) for b in out for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert got == [(i, k) for i in range(30) for k in range(1 if i % 2 else 2)]
