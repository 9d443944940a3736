"""Channel pages and result pages with detail pages, read by selectors: one pass over each page, the rest native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import attr_of, of, read, select
from ..functions.links import LINKS, links_of_text
from ..functions.text import WS, all_words, channel_content, channel_title, collapse, trim, trimmed
from .channels import channel_links

#: Selectors of a channel's page.
MESSAGE = {"wrap": ".tgme_widget_message_wrap", "text": ".tgme_widget_message_text", "time": "time", "post": "[data-post]", "link": ".tgme_widget_message_text a[href]"}
#: Where result pages link to details, in order of trust; then any link that stands in a heading, a list or a container.
RESULT_LINKS = (
    "article .entry-title a", "article h2 a", "article h3 a", ".post-item .entry-title a", ".post .entry-title a", ".entry-title a", ".post-title a", ".article-title a", ".item-title a",
    ".ss-box a", ".ssbox a", ".search-result a", ".result-item a", ".post-list .post a", ".list .item a", ".box .title a", "h2 a", "h3 a", ".card a", ".topic a", ".thread a",
)
PARENTS = "h1 h2 h3 h4 h5 li dd dt".split()
CONTAINERS = "article .post .item .entry .card .topic .thread .ssbox .ss-box".split()
#: Hosts that detail pages are not on; selectors of a detail page.
DRIVES = ("pan.baidu.com", "pan.quark.cn", "aliyundrive.com", "alipan.com", "drive.uc.cn", "pan.xunlei.com", "cloud.189.cn", "115.com", "123pan.com", "mypikpak.com", "caiyun.139.com")
CONTENTS = (".post-content", ".article-content", ".entry-content", ".content", ".post-body", ".article-body", "#content", ".main-content", ".detail-content")
TIMES = "time, .date, .post-date, .published, .entry-date"
#: Sources whose result pages lead to detail pages.
SEARCHED = (
    "aikanzy alupan ash djgou duanjuw dyyj dyyjpro gaoqing888 gying javdb jutoushe kkmao kkv leijing libvio lou1 mizixing panlian panwiki panzun pianku quarksoo quarktv wuji xdpan xiaoji yiove yuhuage yulinshufa yunsou zxzj"
).split()
MOST_DETAILS, LEAST_CONTENT, CONTENT_CHARS, LEAST_TEXT = 6, 20, 500, 4


def messages(pages: DataFrame, limit: int = 50) -> DataFrame:
    """Records of captured channel pages (channel, page, html), the first ``limit`` messages of each channel, in page order.

    ``message_id, unique_id, channel, datetime, title, content, links``: times in UTC, empty where a message has none or
    one that can't be read; the content without links, their access codes and the names of drives.
    """
    m = select(pages.where(F.contains("html", F.lit("tgme_widget_message"))), "html", MESSAGE, "wrap")
    k = F.row_number().over(Window.partitionBy("channel").orderBy("page", "at"))
    m = m.withColumn("k", k).where(F.col("k") <= limit)
    text = trimmed(F.array_join(F.transform(of("text"), lambda e: e["text"]), ""))
    m = m.select("channel", "k", text.alias("text"), attr_of("post", "data-post").alias("post"), attr_of("time", "datetime").alias("time"), F.transform(of("link"), lambda e: e["attrs"]["href"]).alias("hrefs"))
    m = m.withColumn("links", channel_links(F.col("text"), F.col("hrefs")))
    m = m.withColumns({"urls": F.transform("links", lambda x: x["url"]), "first": F.split_part("text", F.lit("\n"), F.lit(1)), "post": F.regexp_extract("post", "([^/]*)$", 1)})
    m = m.withColumns({"bare": F.aggregate("urls", F.col("first"), lambda t, u: F.replace(t, u, F.lit(""))), "clean": _without_codes(F.col("text"), F.col("links")), "at": F.coalesce(F.try_to_timestamp("time"), F.try_to_timestamp("time", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))})
    return m.select(
        F.col("post").alias("message_id"),
        F.concat(F.lit("tg-"), "channel", F.lit("-"), F.when(F.col("post") != "", F.col("post")).otherwise((F.col("k") - 1).cast("string"))).alias("unique_id"),
        "channel",
        F.coalesce(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("")).alias("datetime"),
        channel_title(F.col("bare")).alias("title"),
        channel_content(F.col("clean"), F.col("urls")).alias("content"),
        "links",
    )


def _without_codes(text: Column, links: Column) -> Column:
    """A message without the labelled access codes of its links."""
    label = r"(?i)(?:提取码|密码|pwd|pass(?!word))[:：\s]*"
    codes = F.array_distinct(F.filter(F.transform(links, lambda x: x["password"]), lambda c: F.coalesce(c, F.lit("")) != ""))
    return F.aggregate(codes, text, lambda t, c: F.regexp_replace(t, F.concat(F.lit(label), c), F.lit("")))


def _rules() -> dict[str, str]:
    ranked = {f"{k:02d}": s for k, s in enumerate(RESULT_LINKS)}
    inside = [f"{t} > a[href]" for t in PARENTS] + [f"{c} a[href]" for c in CONTAINERS] + [f"a{c}[href]" for c in CONTAINERS if c[0] == "."]
    return ranked | {"any": ", ".join(inside), "a": "a[href]"}


def admitted_links(inside: str, most: int) -> Column:
    """The first ``most`` addresses of a result page's links that may be detail pages."""
    href = lambda e: F.coalesce(F.try_element_at(e["attrs"], F.lit("href")), F.lit(""))
    listed = F.array_sort(F.transform(F.filter(inside, lambda e: e["rule"] != "a"), lambda e, i: F.struct(e["rule"].alias("rule"), i.alias("i"), href(e).alias("url"), trimmed(e["text"]).alias("text"))))

    def admitted(x: Column) -> Column:
        web = F.startswith(x["url"], F.lit("http"))
        for host in DRIVES:
            web = web & ~F.contains(x["url"], F.lit(host))
        return web & ((x["rule"] != "any") | (F.length(x["text"]) > LEAST_TEXT) & ~F.contains(x["url"], F.lit("#")) & ~F.contains(x["url"], F.lit("javascript:")))

    return F.slice(F.array_distinct(F.transform(F.filter(listed, admitted), lambda x: x["url"])), 1, most)


def detail_urls(pages: DataFrame, most: int = MOST_DETAILS) -> DataFrame:
    """``pages`` (source, html, ...) with ``urls``: the first ``most`` detail pages that each links to, ``links``: drive links of the page itself, and ``content``.

    Links of the trusted places come first, place by place; then those with a text of over four characters inside a
    heading, a list item or a container. Only web addresses count, none of drives; each once.
    """

    def told(root: dict, inside: list[dict]) -> tuple:
        listed = sorted((e["rule"], i, href_of(e), trim(e["text"])) for i, e in enumerate(inside) if e["rule"] != "a")
        urls = dict.fromkeys(url for rule, _, url, text in listed if admits(rule, url, text))
        whole = collapse(root["text"])
        return list(urls)[:most], links_of_text(said_by(inside, whole)), whole[:CONTENT_CHARS]

    return read(pages, "html", _rules(), told, f"urls array<string>, links {LINKS}, content string", spaced=("",))


def href_of(element: dict) -> str:
    return next((v for k, v in element["attrs"] if k == "href"), "")


def admits(rule: str, url: str, text: str) -> bool:
    """Whether a link may lead to a detail page: what ``admitted_links`` says of columns."""
    return url.startswith("http") and not any(h in url for h in DRIVES) and (rule != "any" or len(text) > LEAST_TEXT and "#" not in url and "javascript:" not in url)


def said_by(inside: list[dict], whole: str) -> str:
    """Addresses and texts of links, then the whole text: what ``_said`` says of columns."""
    each = [x for e in inside if e["rule"] == "a" for x in (href_of(e), trim(e["text"])) if x]
    return "\n".join(each) + "\n" + whole


def _collapsed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, f"{WS}+", " "))


def _said(rule: str) -> Column:
    """Addresses and texts of links, then the whole text: where drive links are looked for."""
    each = F.flatten(F.transform(of(rule), lambda e: F.filter(F.array(e["attrs"]["href"], trimmed(e["text"])), lambda x: x != "")))
    return F.concat(F.array_join(each, "\n"), F.lit("\n"), _collapsed(F.col("root.text")))


DETAIL_RULES = {"og": 'meta[property="og:title"]', "h1": "h1", "title": "title", "time": TIMES, "a": "a[href]"} | {f"content {k}": s for k, s in enumerate(CONTENTS)}


def detail(root: dict, inside: list[dict]) -> tuple | None:
    """Title, content, time and drive links of a detail page; none without a drive link."""
    whole = collapse(root["text"])
    links = links_of_text(said_by(inside, whole))
    if not links:
        return None
    first: dict[str, dict] = {}
    for e in inside:
        first.setdefault(e["rule"], e)
    text = lambda rule: trim(first[rule]["text"]) if rule in first else ""
    attr = lambda rule, name: next((v for k, v in first[rule]["attrs"] if k == name), "") if rule in first else ""
    content = next((t for t in (text(f"content {k}") for k in range(len(CONTENTS))) if len(t) > LEAST_CONTENT), whole)
    return attr("og", "content") or text("h1") or text("title"), content[:CONTENT_CHARS], attr("time", "datetime") or text("time"), links


def details(pages: DataFrame) -> DataFrame:
    """``source, url, title, content, datetime, links`` of captured detail pages (source, url, html) that have a drive link."""
    return read(pages.select("source", "url", "html"), "html", DETAIL_RULES, detail, f"title string, content string, datetime string, links {LINKS}", spaced=("",))


def searched(results: DataFrame, captured: DataFrame, keyword: str = "", most: int = MOST_DETAILS) -> DataFrame:
    """Records of captured result pages (source, url, html) of any sources of that kind, joined with captured detail pages (source, url, html).

    A result page gives a record for each detail page that was captured and has a drive link, and one of its own if it
    has drive links itself. Names are lower-cased; a detail page that is captured twice counts once; ``result`` is the
    address of the result page.
    """
    low = F.lower("source").alias("source")
    found = detail_urls(results.select(low, F.col("url").alias("result"), "html"), most)
    pages = details(captured.select(low, "url", "html")).dropDuplicates(["source", "url"])
    pages = pages.select("source", F.col("url").alias("key"), F.struct("datetime", "title", "content", "links").alias("led"))
    wanted = found.select("source", "result", "content", "links", F.posexplode_outer("urls").alias("i", "url"))
    wanted = wanted.withColumns({c: F.when(F.coalesce("i", F.lit(0)) == 0, F.col(c)) for c in ("content", "links")})
    # a result page that leads nowhere has a key of its own, which no row of details has: nulls would all go to one task
    joined = wanted.withColumn("key", F.coalesce("url", F.concat(F.lit("\0"), "result"))).join(pages, ["source", "key"], "left")
    record = lambda i, time, title, content, links: F.struct(i.alias("id"), time.alias("datetime"), title.alias("title"), content.alias("content"), links.alias("links"))
    title = F.when(F.col("led.title") != "", F.col("led.title")).otherwise(F.concat(F.lit("Result "), (F.col("i") + 1).cast("string")))
    made = F.when(F.col("url").isNotNull() & F.col("led").isNotNull(), record(F.md5(F.col("url").cast("binary")), F.col("led.datetime"), title, F.col("led.content"), F.col("led.links")))
    own = F.when(F.size("links") > 0, record(F.concat(F.lit("direct-"), F.md5(F.col("result").cast("binary"))), F.lit(""), F.lit("Search Result"), F.col("content"), F.col("links")))
    rows = joined.select("source", "result", F.explode(F.array_compact(F.array(made, own))).alias("r")).select("source", "result", "r.*").where(all_words(F.lit(keyword), F.col("title"), F.col("content")))
    return rows.select(F.lit("").alias("message_id"), F.concat("source", F.lit("-"), "id").alias("unique_id"), F.lit("").alias("channel"), "datetime", "title", "content", "links", "result")
