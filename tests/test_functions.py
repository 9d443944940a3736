import pytest
from pyspark.sql import functions as F

from tessel.functions import text, urls
from tessel.operators import liveness
from tessel.sources import registry


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column).first()[0]


@pytest.mark.parametrize(("url", "kind"), [("https://PAN.baidu.com/s/1", "baidu"), ("magnet:?xt=urn:btih:a", "magnet"), ("x ed2k://|file|", "ed2k"), ("https://www.115cdn.com/s/1", "115"), ("https://123592.com/s/1", "123"), ("", "others"), (None, "others")])
def test_link_type(spark, url, kind):
    assert one(spark, urls.link_type(F.col("u")), u=url) == kind


@pytest.mark.parametrize(("url", "key"), [
    ("https://pan.quark.cn/s/82a?entry=f#/list", "https://pan.quark.cn/s/82a"),
    ("https://pan.baidu.com/s/1-a?pwd=ab12&x=1", "https://pan.baidu.com/s/1-a?pwd=ab12"),
    ("https://caiyun.139.com/m/i?1a2&x", "https://caiyun.139.com/m/i?1a2"),
    ("https://example.org/x?y", "https://example.org/x?y"),
])
def test_canonical_key(spark, url, key):
    assert one(spark, urls.canonical_key(F.col("u")), u=url) == key


def test_drive_links_of_each_type_without_repeats(spark):
    said = "a https://pan.quark.cn/s/1 b http://pan.quark.cn/s/1 c https://pan.quark.cn/s/2，https://www.alipan.com/s/3 magnet:?xt=urn:btih:4"
    assert sorted(one(spark, urls.drive_links(F.col("t")), t=said)) == ["http://pan.quark.cn/s/1", "https://pan.quark.cn/s/1", "https://pan.quark.cn/s/2", "https://www.alipan.com/s/3", "magnet:?xt=urn:btih:4"]
    assert one(spark, F.size(urls.drive_links(F.col("t"), first_only=True)), t=said) == 3


@pytest.mark.parametrize(("content", "url", "code"), [
    ("", "https://pan.xunlei.com/s/a?pwd=ab12#", "ab12"),
    ("", "https://115.com/s/a?password=cd34", "cd34"),
    ("链接 提取码: x9y8 ", "https://pan.baidu.com/s/1", "x9y8"),
    ("pwd：1234。", "https://pan.quark.cn/s/1", "1234"),
    ("nothing", "https://pan.quark.cn/s/1", ""),
    ("", "https://cloud.189.cn/t/a（访问码：zz9）", "zz9"),
])
def test_access_code(spark, content, url, code):
    assert one(spark, urls.access_code(F.col("c"), F.col("u")), c=content, u=url) == code


def test_unwrapped(spark):
    assert one(spark, urls.unwrapped(F.col("u")), u="https://t.me/x?url=https%3A%2F%2Fpan.quark.cn%2Fs%2F1") == "https://pan.quark.cn/s/1"
    assert one(spark, urls.unwrapped(F.col("u")), u="https://r.jina.ai/https://pan.quark.cn/s/1") == "https://pan.quark.cn/s/1"


def test_normalised_share(spark):
    assert one(spark, urls.normalised_share(F.lit("quark"), F.col("u"), F.lit("ab12")), u=" https://PAN.quark.cn/s/1#x ") == "https://pan.quark.cn/s/1?pwd=ab12"


def test_keywords(spark):
    assert one(spark, text.normalised(F.col("k")), k="The-Movie 2024!") == "themovie2024"
    assert one(spark, text.keyword_variants(F.col("k")), k="【流浪地球】4K 蓝光")[:2] == ["【流浪地球】4K 蓝光", "流浪地球"]
    assert one(spark, text.matches_keyword(F.col("t"), F.lit("流浪地球 4K")), t="流浪-地球 合集")
    assert one(spark, text.all_words(F.lit("a B"), F.col("t"), F.col("c")), t="xA", c="b")


@pytest.mark.parametrize(("term", "kept"), [("  ｆｉｌｍ１ ", "film1"), ("https://x.org", None), ("x" * 21, None), ("赌博网", None), ("　", None), ("ok", "ok")])
def test_admitted_term(spark, term, kept):
    assert one(spark, text.admitted_term(F.col("t")), t=term) == kept


def test_html(spark):
    page = '<meta property="og:title" content="A &amp; B"><h1>C</h1><p>x<br/>y&nbsp;z</p><a class="k" href="/q"> <b>go</b> </a>'
    assert one(spark, text.html_text(F.col("h")), h=page) == "C x y z go"
    assert one(spark, text.page_title(F.col("h")), h=page) == "A & B"
    assert [tuple(a) for a in one(spark, text.anchors(F.col("h")), h=page)] == [("/q", "go")]


def test_sizes_tokens_and_titles(spark):
    assert one(spark, text.size_text(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, text.size_text(F.col("n")), n=0) == "0 B"
    assert one(spark, text.token_url(F.col("t")), t="x.eyJkYXRhIjp7InVybCI6Imh0dHBzOi8vYS5iLyJ9fQ.y") == "https://a.b/"
    assert one(spark, text.chart_term(F.col("t")), t="【9.7】x") == "x"
    assert one(spark, text.channel_title(F.col("t")), t="名称：A - B") == "A B"


Q, B = "https://pan.quark.cn/s/", "https://pan.baidu.com/s/"


@pytest.mark.parametrize(("said", "urls_", "want"), [
    (f"标题：A\n链接：{Q}1", [], {Q + "1": "A"}),
    (f"A\n链接：{Q}1 {Q}2\nB：{Q}3\n夸克：{Q}4", [], {Q + "1": "A", Q + "2": "A", Q + "3": "B", Q + "4": "A"}),
    (f"A\n\nB\n{Q}1\nnot a title\nC\n地址：{Q}2\n网盘:{Q}1", [], {Q + "1": "C", Q + "2": "C"}),
    (f"A\n名称：\n链接：{Q}1", [], {}),
    (f"链接：{Q}1\nlast", [], {}),
    (f"A {Q}1 标题：B {B}2?pwd=abcd {Q}1 C 更新12集 {Q}3", [], {Q + "1": "A", B + "2?pwd=abcd": "B", Q + "3": "C 更新12集"}),
    (f"片名 链接：{Q}1", [], {Q + "1": "片名"}),
    ("A 链接：https://x.org/1 天翼B 链接：https://x.org/2", ["https://x.org/1", "https://x.org/2"], {"https://x.org/1": "A", "https://x.org/2": "天翼B"}),
    ("no link", ["u"], {}), (None, ["u"], {}), ("", [], {}),
])
def test_titles_of_links(spark, said, urls_, want):
    df = spark.createDataFrame([(said, urls_)], "t string, u array<string>")
    assert df.select(text.link_titles(F.col("t"), F.col("u"))).first()[0] == want


def test_links_that_contain_each_other(spark):
    said = f"{Q}abc {Q}abcdef {Q}xyz {B}1 {B}12 https://my.alipan.com/s/1 http://my.alipan.com/s/12 {B}1"
    assert one(spark, urls.drive_links(F.col("t")), t=said) == [B + "1", B + "12", Q + "abc", Q + "xyz", "https://my.alipan.com/s/1"]


@pytest.mark.parametrize(("kind", "status", "body", "state"), [
    ("aliyun", 200, '{"share_name":"a"}', "ok"), ("aliyun", 200, '{"code":"ShareLink.X"}', "bad"), ("aliyun", 200, '{"file_count":0}', "bad"), ("aliyun", 500, "{}", "uncertain"), ("aliyun", 200, "no json", "uncertain"),
    ("quark", 200, '{"token":{"code":41008}}', "locked"), ("quark", 200, '{"token":{"code":41010}}', "bad"),
    ("quark", 200, '{"token":{"code":0,"status":200,"data":{"stoken":"s"}},"detail":{"code":0,"data":{"list":[1],"share":{"status":1}}}}', "ok"),
    ("quark", 200, '{"token":{"code":0,"status":200,"data":{"stoken":"s"}},"detail":{"code":0,"data":{"list":[1],"share":{"status":3,"partial_violation":true}}}}', "bad"),
    ("quark", 200, '{"token":{"code":0,"status":200,"data":{"stoken":"s"}},"detail":{"code":0,"data":{"list":[]}}}', "bad"),
    ("uc", 404, "", "bad"), ("uc", 200, "请输入密码", "locked"), ("uc", 200, "文件", "ok"), ("uc", 200, "?", "uncertain"),
    ("baidu", 200, '{"verify":{"errno":-9}}', "locked"), ("baidu", 200, '{"verify":{"errno":0},"list":{"errno":0,"list":[1]}}', "ok"), ("baidu", 200, '{"list":{"errno":0,"list":[]}}', "bad"), ("baidu", 200, '{"list":{"errno":7}}', "uncertain"),
    ("tianyi", 200, "<shareVO><shareId>5</shareId></shareVO>", "ok"), ("tianyi", 200, "<error><code>ShareNotFound</code></error>", "bad"), ("tianyi", 200, "<error><message>访问码</message></error>", "locked"), ("tianyi", 200, '{"shareId":4}', "ok"), ("tianyi", 200, "", "uncertain"),
    ("123", 403, "", "ok"), ("123", 200, '{"code":0}', "ok"), ("123", 200, '{"code":5,"data":{"HasPwd":true}}', "locked"), ("123", 200, '{"code":5}', "bad"),
    ("xunlei", 404, "", "bad"), ("xunlei", 200, '{"share_status":"OK"}', "ok"), ("xunlei", 200, '{"error":"pass_code_x"}', "locked"), ("xunlei", 200, '{"error_description":"not found"}', "bad"),
    ("115", 200, '{"state":true,"errno":0,"data":{"count":2}}', "ok"), ("115", 200, '{"error":"请输入密码"}', "locked"), ("115", 200, '{"error":"x"}', "bad"), ("115", 200, "{}", "uncertain"),
    ("mobile", 200, '{"resultCode":"0","data":{}}', "ok"), ("mobile", 200, '{"desc":"提取码"}', "locked"), ("mobile", 200, '{"resultCode":"9"}', "bad"), ("magnet", 200, "", "unsupported"),
])
def test_liveness(spark, kind, status, body, state):
    got = spark.createDataFrame([(kind, status, body)], "k string, s int, b string").select(liveness.state(F.col("k"), F.col("s"), F.col("b"))).first()[0]
    assert got == state


def test_json_rows_are_found_anywhere(spark):
    row = '{"name":"A","link":"https://pan.quark.cn/s/1","_id":7}'
    payloads = [("s", f"[{row}]"), ("s", f'{{"rows":[{row}]}}'), ("s", f'{{"n":1,"odd":[{row}]}}'), ("s", "no json"), ("s", '{"data":[]}'), ("s", None)]
    got = registry.from_json(spark.createDataFrame(payloads, "source string, payload string"), "a").collect()
    assert [(r["unique_id"], r["title"], r["links"][0]["url"]) for r in got] == [("s-7", "A", "https://pan.quark.cn/s/1")] * 3


def test_registry_keeps_the_last():
    registry.register(None)
    registry.register(registry.Source(""))
    registry.register(registry.Source("x", 1))
    registry.register(registry.Source("x", 2, True))
    assert [s for s in registry.registered() if s.name == "x"] == [registry.Source("x", 2, True)]
