"""Result pages and detail pages: what is made of them in one pass, against the rules as columns."""

import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tessel import crawl_queries
from tessel.functions import html
from tessel.functions.links import links_in
from tessel.functions.text import collapse, trim, trimmed
from tessel.sources import pages

PIECES = [
    "<h1> a　</h1>", "<title>t &amp; u</title>", '<meta property="og:title" content=" og ">', '<meta property="og:title">', "<time datetime='2024'>x</time>", "<p class='date'> 3 ﻿March</p>", '<div class="content">short</div>',
    '<div class="entry-content">\xa0 long enough to be the content\r\n of it <script>no</script></div>', "<div id=content>", "</div>", "<article><h2>", "</article>", "<li>", "<h3 class=entry-title>", "</h3>", "<ul>", "<a>none</a>", "<a href=''>empty</a>",
    '<a href="https://x.org/1">one two</a>', '<a href="https://x.org/2">abc</a>', '<a href="https://x.org/3#top">a long text</a>', '<a class=card href="http://x.org/4?a=1&amp;b=2">&nbsp;four&nbsp;five</a>', '<a href="javascript:http">a script</a>', "<a href='https://115.com/x'>a drive's</a>",
    '<a href="https://pan.quark.cn/s/ab12">get</a>', "https://pan.baidu.com/s/1x 提取码：ab12 ", " https://pan.baidu.com/s/2y?pwd=cd34\x85\x1c", "密码: zz99 ", "&#x3000;text", "\n\t ", "\r", "中文", "plain text " * 60,
]


def made_pages(n):
    rng = random.Random(3)
    return [(k, "".join(rng.choices(PIECES, k=rng.randint(1, 30)))) for k in range(n)] + [(-1, None), (-2, "")]


def test_pages_in_one_pass_are_those_of_the_columns(spark):
    df = spark.createDataFrame(made_pages(600), "k long, html string").select(F.lit("s").alias("source"), F.col("k").cast("string").alias("url"), "html").repartition(3)
    filled = lambda c: F.nullif(c, F.lit(""))
    p = html.select(df, "html", pages.DETAIL_RULES, spaced=("",)).withColumn("links", links_in(pages._said("a"))).where(F.size("links") > 0)
    told = F.filter(F.array(*[html.text_of(f"content {k}") for k in range(len(pages.CONTENTS))]), lambda t: F.length(t) > pages.LEAST_CONTENT)
    content = F.substring(F.coalesce(F.get(told, F.lit(0)), pages._collapsed(F.col("root.text"))), 1, pages.CONTENT_CHARS)
    title = F.coalesce(filled(html.attr_of("og", "content")), filled(html.text_of("h1")), html.text_of("title"))
    want = p.select("source", "url", title.alias("title"), content.alias("content"), F.coalesce(filled(html.attr_of("time", "datetime")), html.text_of("time")).alias("datetime"), "links")
    got = pages.details(df)
    assert got.columns == want.columns and got.count() > 100
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))

    q = html.select(df, "html", pages._rules(), spaced=("",))
    want = q.select("source", "url", pages.admitted_links("inside", 6).alias("urls"), links_in(pages._said("a")).alias("links"), F.substring(pages._collapsed(F.col("root.text")), 1, pages.CONTENT_CHARS).alias("content"))
    got = pages.detail_urls(df)
    assert got.columns == want.columns and got.count() == 602 and got.where(F.size("urls") > 1).count() > 50
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_texts_as_the_columns_have_them(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("\t\n\x0b\f\r \xa0      　﻿\x1c​ab中", k=rng.randint(0, 12))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pages._collapsed(F.col("t")).alias("c"), trimmed(F.col("t")).alias("s")).collect()
    assert all((collapse(r["t"]), trim(r["t"])) == (r["c"], r["s"]) for r in got)


def test_only_what_is_kept_of_a_page_leaves_python():
    long = '<h1>T</h1><div class="content">' + "x " * 200_000 + "</div> https://pan.quark.cn/s/ab12"
    batch = pa.RecordBatch.from_pydict({"html": [long, None, "<p>no link"] * 4, "url": list(map(str, range(12)))})
    kinds = [pa.string()] * 3 + [pa.list_(pa.struct([(n, pa.string()) for n in ("type", "url", "password")]))]
    out = list(html.told_of(iter([batch, batch.slice(1, 2), batch.slice(0, 0)]), html.Rules(pages.DETAIL_RULES), pages.detail, frozenset({""}), ["url", "title", "content", "datetime", "links"], kinds))
    assert sum(b.nbytes for b in out) < 10_000 and len(out) > 1
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["url"] for r in rows] == ["0", "3", "6", "9"] and all(len(r["content"]) == 500 and r["title"] == "T" and r["links"][0]["url"] == "https://pan.quark.cn/s/ab12" for r in rows)


def test_each_page_is_read_once(spark):
    plan = crawl_queries.searched_sources(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "EvalPython" not in plan


def test_records_of_result_pages(spark):
    one = '<h2><a href="https://x.org/1">a</a> <a href="https://x.org/2">b</a> <a href="https://x.org/3">c</a></h2>'
    own, link = "https://pan.quark.cn/s/own", "https://pan.quark.cn/s/q"
    results = [("Ash", "r1", one), ("ash", "r2", one + own), ("ash", "r3", own), ("ash", "r4", "nothing"), ("ash", "r5", None), ("leijing", "r6", one), (None, "r7", own)]
    captured = [("ash", "https://x.org/1", f"<h1>One</h1>{link}1"), ("ASH", "https://x.org/1", f"<h1>One</h1>{link}1"), ("ash", "https://x.org/2", f"<p>{link}2"), ("ash", "https://x.org/3", "no link"), ("ash", "\0r3", f"{link}3")]
    schema = "source string, url string, html string"
    found = pages.searched(spark.createDataFrame(results, schema), spark.createDataFrame(captured, schema))
    got = sorted((r["result"], str(r["unique_id"]), r["title"], r["content"], [x["url"] for x in r["links"]]) for r in found.collect())
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    led = lambda r: [(r, f"ash-{md5('https://x.org/1')}", "One", f"One {link}1", [link + "1"]), (r, f"ash-{md5('https://x.org/2')}", "Result 2", link + "2", [link + "2"])]
    direct = lambda r, text: (r, f"ash-direct-{md5(r)}", "Search Result", text, [own])
    assert got == sorted([*led("r1"), *led("r2"), direct("r2", f"a b c {own}"), direct("r3", own), ("r7", "None", "Search Result", own, [own])])
    assert pages.searched(spark.createDataFrame(results, schema), spark.createDataFrame(captured, schema), "one").count() == 2
