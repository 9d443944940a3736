from pyspark.sql import functions as F

from tessel.functions.text import link_titles
from tessel.operators import liveness, merge, trending
from tessel.sources import catalogue, channels, registry


def message(text, post="films/41"):
    return f'<div class="tgme_widget_message_wrap"><div class="tgme_widget_message" data-post="{post}"><div class="tgme_widget_message_text">{text}</div></div><time datetime="2023-07-09T18:30:00+00:00"></time></div>'


def test_channel_pages(spark):
    html = message("名称：A - B<br>https://example.org/go?url=https://pan.quark.cn/s/k9x7 密码：w3e5") + message('x <a href="https://115.com/s/q?password=ab12&amp;z">y</a> https://t.me/z', "films/42") + message("none", "")
    pages = spark.createDataFrame([("c", 0, html), ("d", 0, "nothing"), ("e", 0, None)], "channel string, page int, html string")
    got = {r["unique_id"]: r for r in channels.from_channel_pages(pages).collect()}
    assert set(got) == {"tg-c-41", "tg-c-42", "tg-c-2"} and channels.from_channel_pages(pages).count() == 3
    assert [tuple(l) for l in got["tg-c-41"]["links"]] == [("quark", "https://pan.quark.cn/s/k9x7", "w3e5")]
    assert got["tg-c-41"]["title"] == "A B" and got["tg-c-41"]["datetime"].startswith("2023")
    assert [tuple(l) for l in channels.from_channel_pages(pages.limit(1)).where("message_id = '42'").first()["links"]] == [("115", "https://115.com/s/q?password=ab12", "ab12")]
    assert channels.from_channel_pages(pages, 1).count() == 1


def test_answers_of_any_shape(spark):
    rows = [
        (1, '{"merged_by_type":{"quark":[{"url":"u","password":"p","note":"n"}]}}'),
        (2, '{"results":[{"title":"t","channel":"c","datetime":"d","links":[{"type":"baidu","url":"a"},{"url":"b","password":"x"}]}]}'),
        (3, '{"results":[{"url":"f","type":"uc","note":"z"}]}'), (4, '{"items":[{"url":"i"}]}'), (5, '[{"url":"j","type":"115"}]'), (6, "{}"), (7, None), (8, "no json"),
    ]
    got = {(r["id"], r["link_type"], r["url"], r["password"], r["note"], r["source"]) for r in channels.from_answers(spark.createDataFrame(rows, "id int, payload string")).collect()}
    assert got == {(1, "quark", "u", "p", "n", None), (2, "baidu", "a", "", "t", "tg:c"), (2, "others", "b", "x", "t", "tg:c"), (3, "uc", "f", "", "z", None), (4, "others", "i", "", "", None), (5, "115", "j", "", "", None)}


def test_chart_payloads(spark):
    j = spark.createDataFrame([("c", 20, '[{"id":"7","title":"A","score":"9.1","types":["x","y"],"regions":["z"]},{"id":"8","title":"B"}]')], "category string, start int, payload string")
    assert [(r["pos"], r["id"], r["title"], r["text"]) for r in channels.from_chart_json(j).orderBy("pos").collect()] == [(20, 7, "【9.1】A", "x/y · z"), (21, 8, "B", "")]
    item = '<li><div class="item"><div class="pic"><a href="https://m.example/subject/12/"></a></div><span class="title">T</span><span class="rating_num" p="v">9.7</span><span class="inq">q</span></div></li>'
    h = spark.createDataFrame([("t", 1, f"<ol>{item}{item.replace('T', '')}</ol>")], "category string, page int, html string")
    assert [tuple(r) for r in channels.from_chart_pages(h).select("pos", "id", "title", "text").collect()] == [(25, 12, "【9.7】T", "q")]


def test_catalogue(spark):
    catalogue.register_all()
    levels = registry.dimension(spark).where(F.col("name").isin(*catalogue.LEVEL_1, *catalogue.LEVEL_2, *catalogue.LEVEL_3, *catalogue.LEVEL_4)).groupBy("level").count().collect()
    assert {r["level"]: r["count"] for r in levels} == {1: 4, 2: 18, 3: 43, 4: 3}


def test_channels_of_a_settings_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"defaultChannels": ["b", "a", "b", " "],\n "priorityChannels": ["a", "z"], "other": 1}')
    got = sorted((r["ordinal"], r["name"], r["priority"]) for r in catalogue.channels(spark, str(tmp_path / "c.json")).collect())
    assert [(n, p) for _, n, p in got] == [("b", False), ("a", True), ("z", True)]


def test_notes_of_links(spark):
    content = "标题：Film\n链接：https://pan.quark.cn/s/1?x"
    df = spark.createDataFrame([("https://pan.quark.cn/s/1", "Other", content), ("https://pan.quark.cn/s/2", "Other", content)], "url string, title string, content string")
    got = merge.with_notes(df.withColumn("titles", link_titles(F.col("content")))).orderBy("url").collect()
    assert [r["note"] for r in got] == ["Film", "Other"]
    assert merge.with_notes(df.withColumn("titles", link_titles(F.col("content"))), "other").orderBy("url").first()["note"] == "Other"


def test_table_function(spark):
    spark.createDataFrame([("s-1", "A film", "b"), ("s-2", "Film", "c")], "unique_id string, title string, content string").createOrReplaceTempView("captured")
    registry.as_table_function(spark, "captured_search", "captured")
    assert [r["unique_id"] for r in spark.sql("SELECT * FROM captured_search('FILM  b')").collect()] == ["s-1"]


def test_detail_urls_and_page_data(spark):
    html = '<a href="https://x.org/1">a long text</a><a href="https://x.org/2">ab</a><a href="https://pan.quark.cn/s/1">a long text</a><script id="__NEXT_DATA__" type="j">{"a":1}</script>'
    df = spark.createDataFrame([("s", html)], "source string, html string")
    assert [r["url"] for r in channels.detail_urls(df).collect()] == ["https://x.org/1"]
    assert df.select(F.get_json_object(channels.page_data(F.col("html")), "$.a")).first()[0] == "1"


def test_terms_and_cached_states(spark):
    stored = spark.createDataFrame([("a", 3)], "term string, score long")
    assert {tuple(r) for r in trending.load_terms(stored, spark.createDataFrame([("a", 9), ("b", 1)], "term string, score long")).collect()} == {("a", 3), ("b", 1)}
    assert trending.without_term(stored, "a").count() == 0
    links = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    cache = spark.createDataFrame([("u", "ok", 10), ("v", "bad", 5)], "url string, state string, expires_at long")
    known, open_ = liveness.split_cached(links, cache, F.lit(5))
    assert [r["url"] for r in known.collect()] == ["u"] and sorted(r["url"] for r in open_.collect()) == ["v", "w"]
