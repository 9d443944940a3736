"""Captured channel pages, chart payloads and API answers as rows; all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import channel_content, channel_title, html_text, trimmed
from ..functions.urls import canonical_key, decoded, unwrapped_all
from ..operators.charts import PAGE, chart_title

#: Marks of a channel's page, URLs and access codes of its messages.
WRAP, BODY = '<div class="tgme_widget_message_wrap', r'(?is)tgme_widget_message_text[^>]*>(.*?)</div>'
URL = r"(?:https?://|magnet:\?)[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"
CODE = r"(?i)(?:提取码|密码|pwd|pass(?!word))[:：\s]*([a-zA-Z0-9]{3,6})"
CODES_IN_URLS = ((r"115\.com|115cdn\.com|anxia\.com", r"password=([a-zA-Z0-9]{4})"), (r"pan\.(?:baidu|xunlei)\.com", r"[?&]pwd=([a-zA-Z0-9]{4})"))
LIST_ITEM = r'(?is)<div class="item">.*?</li>'


def channel_links(text: Column, hrefs: Column) -> Column:
    """The drive links of a message: unwrapped, canonical, without repeats, each with its own access code or the message's."""
    raw = F.concat(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), hrefs)
    said = F.regexp_extract(text, CODE, 1)

    def resolve(x: Column) -> Column:
        at = x["url"]
        kind = F.when(F.startswith(at, F.lit("magnet:")), "magnet").otherwise(x["kind"])
        own = F.coalesce(*[F.when(at.rlike(host), F.nullif(F.regexp_extract(at, p, 1), F.lit(""))) for host, p in CODES_IN_URLS], said)
        return F.struct(kind.alias("type"), canonical_key(at).alias("url"), own.alias("password"))

    found = F.filter(F.transform(unwrapped_all(raw), resolve), lambda x: x["type"] != "")
    fresh = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y["url"]) == F.lower(x["url"])), acc).otherwise(F.array_append(acc, x))
    return F.aggregate(found, F.expr("CAST(array() AS array<struct<type:string,url:string,password:string>>)"), fresh)


def from_channel_pages(pages: DataFrame, limit: int = 50) -> DataFrame:
    """Records of captured channel pages (channel, page, html), the first ``limit`` messages of each channel.

    Pages without a message are left out before anything is parsed. Ids are of the post, or of the place if it has none.
    """
    parts = F.slice(F.split("html", WRAP), 2, 2**31 - 1)
    m = pages.where(F.contains("html", F.lit(WRAP))).select("channel", "page", F.posexplode(parts).alias("i", "part"))
    at = F.row_number().over(Window.partitionBy("channel").orderBy("page", "i"))
    m = m.withColumn("k", at).where(F.col("k") <= limit)
    body = F.regexp_extract("part", BODY, 1)
    lined = F.regexp_replace(F.regexp_replace(body, r"(?i)<br\s*/?>", "\n"), "<[^>]+>", "")
    m = m.withColumns({"text": trimmed(F.replace(lined, F.lit("&amp;"), F.lit("&"))), "hrefs": F.transform(F.regexp_extract_all(body, F.lit(r'(?is)<a\s[^>]*href="([^"]*)"'), F.lit(1)), lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))})
    m = m.withColumns({"links": channel_links(F.col("text"), F.col("hrefs")), "post": F.regexp_extract("part", r'data-post="[^"/]*/?([^"]*)"', 1)})
    bare = F.aggregate(F.transform("links", lambda x: x["url"]), F.split_part("text", F.lit("\n"), F.lit(1)), lambda t, u: F.replace(t, u, F.lit("")))
    return m.select(
        F.col("post").alias("message_id"),
        F.concat(F.lit("tg-"), "channel", F.lit("-"), F.when(F.col("post") != "", F.col("post")).otherwise((F.col("k") - 1).cast("string"))).alias("unique_id"),
        "channel",
        F.regexp_extract("part", r'<time[^>]*datetime="([^"]*)"', 1).alias("datetime"),
        channel_title(bare).alias("title"),
        channel_content(F.col("text"), F.transform("links", lambda x: x["url"])).alias("content"),
        "links",
    )


def from_chart_json(payloads: DataFrame) -> DataFrame:
    """Items of captured chart answers (category, start, payload: a JSON list), with ``pos`` in the chart."""
    kind = "array<struct<id:string,title:string,score:string,rating:array<string>,types:array<string>,regions:array<string>,url:string,cover_url:string>>"
    i = payloads.select("category", "start", F.posexplode(F.from_json("payload", kind)).alias("i", "x"))
    score = F.coalesce(F.nullif(F.col("x.score"), F.lit("")), F.get("x.rating", F.lit(0)))
    joined = lambda c: F.nullif(F.array_join(c, "/"), F.lit(""))
    return i.select("category", (F.col("start") + F.col("i")).alias("pos"), F.col("x.id").try_cast("long").alias("id"), F.when(score.isNotNull(), chart_title(score, F.col("x.title"))).otherwise(F.col("x.title")).alias("title"), F.concat_ws(" · ", joined("x.types"), joined("x.regions")).alias("text"), F.col("x.url").alias("url"))


def from_chart_pages(pages: DataFrame, per_page: int = 25) -> DataFrame:
    """Items of captured chart pages (category, page, html); items without a title are left out."""
    i = pages.select("category", "page", F.posexplode(F.regexp_extract_all("html", F.lit(LIST_ITEM), F.lit(0))).alias("i", "x"))
    pick = lambda p: html_text(F.regexp_extract("x", p, 1))
    title, score, url = pick(r'(?is)<span class="title">(.*?)</span>'), pick(r'(?is)class="rating_num"[^>]*>(.*?)</span>'), F.regexp_extract("x", r'(?is)<a\s[^>]*href="([^"]*)"', 1)
    out = i.select("category", (F.col("page") * per_page + F.col("i")).alias("pos"), F.regexp_extract(url, r"\d+", 0).try_cast("long").alias("id"), F.when(title != "", chart_title(F.when(score != "", score).otherwise("0.0"), title)).alias("title"), pick(r'(?is)<span class="inq">(.*?)</span>').alias("text"), url.alias("url"))
    return out.where("title is not null")


def paged(rows: DataFrame, size: int = PAGE) -> DataFrame:
    """Rows with ``pos`` as pages of a fixed size: ``page`` from 1, ``place`` from 0."""
    return rows.withColumns({"page": F.floor(F.col("pos") / size) + 1, "place": F.col("pos") % size})


LINK = "url string, password string, note string, datetime string, source string, type string"


def from_answers(answers: DataFrame) -> DataFrame:
    """``id, link_type, url, password, note, datetime, source`` of search answers (id, payload) of any shape.

    Grouped links come first; else results with nested links or as links; else a list at the top or in items, list or data.
    """
    v = F.try_parse_json("payload")
    flat = f"array<struct<{LINK.replace(' string', ':string')}>>"
    grouped = F.from_json(F.get_json_object("payload", "$.merged_by_type"), f"map<string,{flat}>")
    results = F.from_json(F.get_json_object("payload", "$.results"), f"array<struct<{LINK.replace(' string', ':string')},title:string,content:string,channel:string,links:{flat}>>")
    listed = F.from_json(F.coalesce(F.when(F.schema_of_variant(v).startswith("ARRAY"), F.col("payload")), *[F.get_json_object("payload", f"$.{k}") for k in ("items", "list", "data")]), flat)
    a = answers.select("id", grouped.alias("g"), results.alias("r"), listed.alias("l"))
    row = lambda kind, x, note, when, source: F.struct(F.when(F.coalesce(kind, F.lit("")) != "", kind).otherwise("others").alias("link_type"), x["url"].alias("url"), F.coalesce(x["password"], F.lit("")).alias("password"), F.coalesce(note, F.lit("")).alias("note"), F.coalesce(when, F.lit("")).alias("datetime"), source.alias("source"))
    from_groups = F.flatten(F.transform(F.map_entries("g"), lambda e: F.transform(e["value"], lambda x: row(e["key"], x, x["note"], x["datetime"], x["source"]))))

    def of_result(r):
        note = F.coalesce(F.nullif(r["title"], F.lit("")), r["content"])
        label = F.when(F.coalesce(r["channel"], F.lit("")) != "", F.concat(F.lit("tg:"), r["channel"]))
        nested = F.transform(r["links"], lambda x: row(x["type"], x, note, r["datetime"], label))
        return F.when(F.size(F.coalesce(r["links"], F.array())) > 0, nested).otherwise(F.array(row(r["type"], r, r["note"], r["datetime"], r["source"])))

    from_results = F.flatten(F.transform("r", of_result))
    from_list = F.transform("l", lambda x: row(x["type"], x, x["note"], x["datetime"], x["source"]))
    some = F.when(F.size("g") > 0, from_groups).when(F.size("r") > 0, from_results).otherwise(from_list)
    return a.select("id", F.explode(some).alias("x")).select("id", "x.*").where("url is not null")


def page_data(html: Column) -> Column:
    """The JSON that a page carries in its data script."""
    return F.nullif(F.regexp_extract(html, r'(?is)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit(""))


def detail_urls(page: DataFrame, hosts: str = r"pan\.|drive\.|alipan|aliyundrive|115\.com|123pan") -> DataFrame:
    """Links of a results page (source, html) that may be detail pages: web links, not of drives, with a text of over four characters."""
    from ..functions.text import anchors

    a = page.select("source", F.explode(anchors(F.col("html"))).alias("a")).select("source", decoded(F.col("a.href")).alias("url"), F.col("a.text").alias("text"))
    return a.where(F.col("url").rlike("^https?://") & ~F.col("url").rlike(hosts) & (F.length("text") > 4)).dropDuplicates(["source", "url"])
