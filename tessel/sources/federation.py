"""All sources in one read: their layouts are rows of a table that is joined with the scan, not plans of their own.

A payload's source brings its declaration along, as columns: where its items are, and by which paths or selectors their
fields are found. So one scan, one join with the declarations of the healthy sources and one pass over the items serve
JSON answers, pages of cards, tables of torrents and result pages; those whose links stand on detail pages are then joined
with one scan of these.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import attr_of, of, text_of
from ..functions.links import links_in
from ..functions.text import html_text, token_url, trimmed
from ..functions.urls import share_password
from ..operators.filters import of_healthy
from . import registry
from .custom import ABOUT, ANY_URL, DISK_TYPES, POOL_TYPES, SHORT_TYPES, kind_of
from .pages import CONTENTS, CONTENT_CHARS, LEAST_CONTENT, LEAST_TEXT, MOST_DETAILS, SEARCHED, TIMES, _rules, _said, admitted_links

LINKS = "array<struct<type:string,url:string,password:string>>"


@dataclass(frozen=True)
class Layout:
    """How one source answers. Paths are tried in turn; ``mode`` says where links are.

    zip: two lists delimited by $$$ in ``names`` and ``urls`` (with ``sections`` an entry is a name, $, and links between #);
    field: the address in ``urls``; text: every address in ``urls``, or anywhere in the item; any: as text, by the rules of
    drive links; magnet: of a page's element; page: drive links of an element; detail: on detail pages, found by ``key``;
    searched: on the detail pages that a result page leads to.
    """

    name: str
    mode: str
    rows: tuple[str, ...] = ()
    title: tuple[str, ...] = ("title", "name")
    titled: tuple[str, ...] = ()  # patterns, tried in turn on the title
    content: tuple[tuple[str, str], ...] = ()
    cells: tuple[tuple[str, int], ...] = ()
    most: int = 0  # characters of the content; 0: all
    time: tuple[str, ...] = ()
    id: tuple[str, ...] = ("id",)
    tags: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    urls: tuple[str, ...] = ()
    password: tuple[str, ...] = ()
    types: dict = field(default_factory=dict, hash=False)
    agrees: bool = False
    known_only: bool = False
    sections: bool = False
    hosts: str = ""  # links must match it
    key: str = "()"  # the pattern of what an item and its detail page have in common
    last: bool = False  # the title is the last element of its selector
    dots: bool = False
    each: bool = False  # a record for each link of a detail page
    bare: bool = False  # items without links stay
    prefix: str = ""
    # selectors of pages: of an item, and of what is inside
    root: str = ""
    select: dict = field(default_factory=dict, hash=False)
    detail: str = ""


VOD = dict(mode="zip", rows=("list",), title=("vod_name",), id=("vod_id",), names=("vod_down_from",), urls=("vod_down_url",), content=ABOUT, tags=("vod_year", "vod_area"))
SHARED = dict(mode="field", rows=("data", "data.list", "results", "list"), urls=("url", "share_url"), time=("share_time", "created_at"), id=("full_id", "qid"), content=(("用户: ", "user"),), known_only=True)
TITLE_LINKS = "h2 a, h3 a, .title a, .entry-title a, a"
PAGED = dict(mode="page", select={"title": TITLE_LINKS, "id": "", "a": "a[href]"}, most=CONTENT_CHARS)
VOD_PAGE = dict(mode="detail", root=".module-search-item", key=r"/vod(?:/detail|detail)?/(?:id/)?(\d+)", detail="#download-list a[href], #download-list [data-clipboard-text], [data-clipboard-text]")
#: The 27 sources with layouts of their own: names, paths, selectors, labels.
OWN = (
    Layout("wanou", **VOD, types=SHORT_TYPES, agrees=True),
    Layout("ouge", **VOD, types=SHORT_TYPES),
    Layout("huban", **VOD, types=DISK_TYPES, sections=True, known_only=True),
    Layout("yunso", **SHARED),
    Layout("xys", **SHARED),
    Layout("meitizy", "field", ("data", "data.list", "results", "list"), urls=("url", "share_url"), time=("create_time",), known_only=True),
    Layout("melost", "field", ("data", "data.list", "results", "list"), urls=("url", "share_url", "links[0].url"), password=("links[0].password",), time=("share_time",), id=("disk_id", "id"), content=(("用户: ", "user"),)),
    Layout("xdyh", "text", ("data", "data.list", "results", "list"), title=("title", "name", "share_title"), content=(("", "content"), ("", "description")), time=("created_at", "time", "date"), known_only=True),
    Layout("hunhepan", "field", ("data.list",), title=("disk_name",), content=(("", "files"),), time=("shared_time",), id=("disk_id",), names=("disk_type",), urls=("link",), password=("disk_pass",), types=POOL_TYPES, known_only=True),
    Layout("pansearch", "text", ("pageProps.data.data",), title=("content",), titled=(r"名称：([^<\n]+)",), content=(("", "content"),), time=("time",), urls=("content",)),
    Layout("panyq", "detail", ("data.hits",), title=("desc",), titled=(r"《([^》]+)》", r"【([^】]+)】", r"(?s)^(.{1,30})"), content=(("", "desc"),), id=("eid",), key=r"/go/([^/?#]+)"),
    Layout("mikuclub", "text", ("data",), title=("title.rendered", "title"), content=(("", "content.rendered"), ("", "content")), time=("date",), known_only=True, most=CONTENT_CHARS),
    Layout("jsnoteclub", "text", ("posts",), title=("title",), content=(("", "excerpt"),), time=("updated_at",), urls=("excerpt",), hosts=r"(?i)pan\.(?:quark|baidu)\.cn|drive\.uc\.cn|aliyundrive\.com|alipan\.com|pan\.xunlei\.com|cloud\.189\.cn|115\.com|123pan\.com|123684\.com|caiyun\.139\.com|share\.weiyun\.com|lanzou|lanzo|mypikpak\.com"),
    Layout("lingjisp", "detail", ("data", "data.list"), content=(("评分: ", "score"),), time=("release_date",), id=("doub_id",), key=r"[?&]id=(\d+)"),
    Layout("pan666", "detail", ("data",), title=("attributes.title",), time=("attributes.createdAt",), key=r"/d/(\d+)"),
    Layout("pioz", "page", root=".resource-card, .card, .item, .list-item", select={"title": ".card-title, .title, h3, h4", "content": ".card-text, .desc, .description, p", "a": "a[href]"}, hosts=r"pan\.quark\.cn/s/"),
    Layout("u3c3", root="article, .post, .item, .entry, .card, .list-item, .search-result-item, li", **PAGED),
    Layout("xb6v", root="article, .post, .item, .entry, .card, .list-item, li", **PAGED),
    Layout("thepiratebay", "magnet", root="tr", select={"title": ".detLink", "id": ".detLink", "magnet": "a[href^='magnet:']", "td": "td"}, key=r"/torrent/(\d+)", cells=(("Seeders: ", 2), ("Leechers: ", 3)), dots=True),
    Layout("nyaa", "magnet", root="table tbody tr", select={"title": "a[href^='/view/']", "id": "a[href^='/view/']", "magnet": "a[href^='magnet:']", "td": "td"}, key=r"/view/(\d+)", cells=(("Size: ", 3), ("Seeders: ", 5), ("Leechers: ", 6)), last=True, detail="a[href^='magnet:']"),
    Layout("1337x", "detail", root="table.table-list tbody tr", select={"title": "td.coll-1 a", "id": "td.coll-1 a"}, key=r"/torrent/(\d+)", last=True, detail="a[href^='magnet:']"),
    Layout("solidtorrents", "field", ("results",), urls=("magnet",), id=("id", "title"), content=(("Size: ", "size"), ("Seeders: ", "seeders"), ("Leechers: ", "leechers"), ("Uploaded: ", "uploaded")), prefix="solid"),
    Layout("duoduo", **VOD_PAGE, select={"title": ".video-info-header h3 a", "id": ".video-info-header h3 a", "content": ".video-serial", "tag": ".video-info-aux .tag-link a"}),
    Layout("labi", **VOD_PAGE, select={"title": ".video-info-header h3 a", "id": ".module-item-pic a", "content": ".video-serial", "tag": ".video-info-aux .tag-link a"}),
    Layout("susu", "detail", root=".post-list-item", select={"title": ".post-info h2 a", "id": ".post-info h2 a", "content": ".post-excerpt", "time": ".list-footer time.b2timeago", "tag": ".post-list-cat-item"}, key=r"/(\d+)\.html", bare=True),
    Layout("clxiong", "detail", root=".row.row-cols-2.row-cols-lg-4 .col", select={"title": "a[href*='/drama/'] h2.h4, a[href*='/movie/'] h2.h4", "id": "a[href*='/drama/'], a[href*='/movie/']"}, key=r"/(?:drama|movie)/(\d+)", detail="a[href^='magnet:']", each=True),
    Layout("xiaozhang", "detail", root=".list-boxes", select={"title": "a.text_title_p", "id": "a.text_title_p", "content": "p.text_p", "time": ".list-actions span"}, key=r"/subject/(\d+)\.html", detail="p a[href]"),
)
#: Sources that answer with JSON of any shape.
ANY_JSON = "bixin discourse haisou jupansou miaoso nsgame qqpd quark4k sousou weibo".split()
LAYOUTS = {x.name: x for x in (
    *OWN,
    *(Layout(n, "searched", key="^(.*)$", most=CONTENT_CHARS) for n in SEARCHED),
    *(Layout(n, "any", registry.ARRAYS, registry.TITLES, content=tuple(("", p) for p in registry.CONTENTS), time=registry.TIMES, id=registry.IDS, urls=registry.CONTENTS) for n in ANY_JSON),
)}
DETAIL_RULES = {"og": 'meta[property="og:title"]', "h1": "h1", "page title": "title", "time": TIMES, "a": "a[href]"} | {f"content {k}": s for k, s in enumerate(CONTENTS)}


def page_rules() -> dict[str, tuple[dict, str | None, tuple]]:
    """Selectors of the sources that answer with pages; of ``name detail`` for their detail pages."""
    rules = {}
    for x in LAYOUTS.values():
        if x.mode == "searched":
            rules[x.name] = (_rules(), None, ("",))
        elif x.root:
            chosen = {k: s for k, s in x.select.items() if s} | ({"id": x.select["title"]} if x.select.get("id") == "" else {})
            rules[x.name] = ({"root": x.root} | chosen, "root", ("root",) if x.mode == "page" else ())
        if x.mode == "searched" or x.detail:
            rules[f"{x.name} detail"] = (DETAIL_RULES if x.mode == "searched" else {"link": x.detail, "a": "[href], [data-clipboard-text]"}, None, ("",))
    return rules


SPEC = f"""name string, mode string, rows array<string>, title array<string>, titled array<string>, content array<struct<label:string,path:string>>, cells array<struct<label:string,cell:int>>, most int,
  time array<string>, id array<string>, tags array<string>, names array<string>, urls array<string>, password array<string>, types map<string,string>, agrees boolean, known_only boolean, sections boolean,
  hosts string, key string, last boolean, dots boolean, each boolean, bare boolean, prefix string"""


def declarations(spark: SparkSession, chosen: tuple[str, ...] = ()) -> DataFrame:
    """The layouts as a table (68 rows at most), of the chosen sources or all."""
    low = {c.lower() for c in chosen}
    kept = [asdict(x) for x in LAYOUTS.values() if not low or x.name in low]
    pathed = {"rows", "title", "time", "id", "tags", "names", "urls", "password"}
    names = [part.split()[0] for part in SPEC.replace("\n", " ").replace("label:string,", "").split(", ")]
    to = lambda k, v, page: ["$." + p for p in v] if k in pathed else [(a, "$." + b) for a, b in v] if k == "content" else v or (None if k == "types" else v)
    return spark.createDataFrame([tuple(to(k, x[k], x["root"]) for k in names) for x in kept], SPEC)


def _pick(item: Column, paths: Column) -> Column:
    """The first path that is filled."""
    found = F.transform(paths, lambda p: trimmed(F.try_variant_get(item, p, "string")))
    return F.coalesce(F.get(F.filter(found, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0)), F.lit(""))


def _link(kind: Column, url: Column, password: Column) -> Column:
    return F.struct(kind.alias("type"), url.alias("url"), F.coalesce(password, F.lit("")).alias("password"))


def _plain(urls: Column) -> Column:
    """Addresses as links by their hosts."""
    return F.transform(F.array_distinct(urls), lambda u: _link(kind_of(u), u, share_password(u, F.lit(""))))


def _none() -> Column:
    return F.expr(f"CAST(array() AS {LINKS})")


def _extracted(text: Column, pattern: str) -> Column:
    return F.call_function("regexp_extract", text, F.col(pattern) if pattern.isidentifier() else F.lit(pattern), F.lit(1))


def _zipped() -> Column:
    """Links of two delimited lists; names that the layout maps decide types, or must agree with the host."""
    kinds, urls = F.split(_pick(F.col("item"), F.col("names")), r"\$\$\$"), F.split(_pick(F.col("item"), F.col("urls")), r"\$\$\$")
    n = F.least(F.size(kinds), F.size(urls))
    both = F.arrays_zip(F.slice(kinds, F.lit(1), n).alias("n"), F.slice(urls, F.lit(1), n).alias("u"))
    cut = lambda u: F.when(F.col("sections"), F.split(F.regexp_replace(u, r"^[^$]*\$", ""), "#")).otherwise(F.array(u))
    flat = F.flatten(F.transform(both, lambda x: F.transform(cut(x["u"]), lambda u: F.struct(F.upper(trimmed(x["n"])).alias("n"), trimmed(u).alias("u")))))

    def typed(x: Column) -> Column:
        known, host = F.try_element_at(F.col("types"), x["n"]), kind_of(x["u"])
        kind = F.when(F.col("agrees"), F.when(known.isNull() | (known == host), host).otherwise("")).otherwise(F.coalesce(known, F.when(F.col("sections"), "others").otherwise(host)))
        return _link(kind, x["u"], share_password(x["u"], F.lit("")))

    return F.transform(flat, typed)


def items(scan: DataFrame) -> DataFrame:
    """Records to be, of a scan (source, url, payload, at, root, inside) joined with the layouts: with ``links`` of their own, and ``keys`` of detail pages."""
    v = F.try_parse_json("payload")
    listed = F.filter(F.concat(F.transform("rows", lambda p: F.try_variant_get(v, p, "array<variant>")), F.array(F.try_variant_get(v, F.lit("$"), "array<variant>"))), lambda x: x.isNotNull())
    fields = F.filter(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: F.schema_of_variant(x).startswith("ARRAY"))
    fallback = F.when(F.col("mode") == "any", F.try_variant_get(F.get(fields, F.lit(0)), "$", "array<variant>"))
    r = scan.withColumn("rows", F.when(F.col("payload").isNotNull(), F.coalesce(F.get(listed, F.lit(0)), fallback, F.expr("CAST(array() AS array<variant>)"))).otherwise(F.array(F.parse_json(F.lit("null")))))
    r = r.select("*", F.posexplode("rows").alias("i", "item")).drop("rows", "payload")
    page, item = F.col("root").isNotNull(), F.col("item")
    said = F.transform("content", lambda c: F.struct(c["label"].alias("label"), trimmed(F.try_variant_get(item, c["path"], "string")).alias("text")))
    cells = F.transform("cells", lambda c: F.struct(c["label"].alias("label"), trimmed(F.coalesce(F.get(of("td"), c["cell"])["text"], F.lit(""))).alias("text")))
    told = F.filter(F.concat(said, cells), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    title = F.when(F.col("last"), F.coalesce(trimmed(F.element_at(of("title"), -1)["text"]), F.lit(""))).otherwise(text_of("title"))
    href = F.when(F.col("last"), F.element_at(of("id"), -1)["attrs"]["href"]).otherwise(attr_of("id", "href"))
    a = r.withColumns({
        "name_": F.when(page, title).otherwise(html_text(_pick(item, F.col("title")))),
        "id_": F.when(page, _extracted(F.coalesce(href, F.lit("")), "key")).otherwise(_pick(item, F.col("id"))),
        "told": told,
        "time_": F.when(page, F.coalesce(F.nullif(attr_of("time", "datetime"), F.lit("")), text_of("time"))).otherwise(_pick(item, F.col("time"))),
        "tags_": F.when(page, F.transform(of("tag"), lambda e: trimmed(e["text"]))).otherwise(F.filter(F.transform("tags", lambda t: _pick(item, F.array(t))), lambda t: t != "")),
        "text_": F.when(page, _said("a")).when(F.col("mode") == "any", F.concat(_pick(item, F.col("urls")), F.lit(" "), F.to_json("item"))),
        "raw_": F.when(F.col("mode") == "text", F.when(F.size("urls") > 0, _pick(item, F.col("urls"))).otherwise(F.replace(F.to_json("item"), F.lit("\\/"), F.lit("/")))),
        "urls_": F.when(F.col("mode") == "searched", admitted_links("inside", MOST_DETAILS)),
    })
    url = _pick(item, F.col("urls"))
    typed = F.coalesce(F.try_element_at(F.col("types"), F.upper(_pick(item, F.col("names")))), kind_of(url))
    magnets = F.filter(F.transform(of("magnet"), lambda e: _link(F.lit("magnet"), e["attrs"]["href"], F.lit(""))), lambda x: x["url"].isNotNull())
    links = (
        F.when(F.col("mode") == "zip", _zipped())
        .when(F.col("mode") == "field", F.array(_link(typed, url, share_password(url, _pick(item, F.col("password"))))))
        .when(F.col("mode") == "text", _plain(F.regexp_extract_all("raw_", F.lit(ANY_URL), F.lit(0))))
        .when(F.col("mode") == "magnet", F.slice(magnets, 1, 1))
    )
    drives = links_in(F.when(F.col("mode").isin("any", "page", "searched"), F.col("text_")))
    a = a.withColumn("links", F.when(F.col("mode").isin("any", "page", "searched"), drives).otherwise(F.coalesce(links, _none())))
    fits = lambda x: x["url"].rlike("^(?:https?:|magnet:|ed2k:)") & (x["type"] != "") & (~F.col("known_only") | (x["type"] != "others")) & ((F.col("hosts") == "") | F.call_function("regexp_like", x["url"], F.col("hosts")))
    content = F.array_join(F.transform("told", lambda x: F.concat(x["label"], x["text"])), " | ")
    whole = F.when(F.col("mode").isin("page", "searched") & F.array_contains(F.array(*map(F.lit, ("u3c3", "xb6v", *SEARCHED))), F.col("source")), trimmed(F.regexp_replace("root.text", r"\s+", " "))).when(page & (F.size("told") == 0), text_of("content")).when(F.col("mode") == "any", html_text(F.get("told", F.lit(0))["text"])).when(F.col("source").isin("pansearch", "panyq", "mikuclub"), html_text(F.get("told", F.lit(0))["text"])).otherwise(content)
    named = F.when(F.size("titled") > 0, F.get(F.filter(F.transform("titled", lambda p: F.call_function("regexp_extract", F.col("name_"), p, F.lit(1))), lambda x: x != ""), F.lit(0))).otherwise(F.when(F.col("dots"), F.replace("name_", F.lit("."), F.lit(" "))).otherwise(F.col("name_")))
    return a.select(
        "source", F.when(F.col("prefix") != "", F.col("prefix")).otherwise(F.col("source")).alias("prefix"), "mode", "each", "bare", F.col("url").alias("asked"), F.when(page, F.col("at")).otherwise(F.col("i")).alias("i"),
        F.col("id_").alias("id"), F.coalesce(trimmed(named), F.lit("")).alias("title"), F.when(F.col("most") > 0, F.substring(whole, F.lit(1), F.col("most"))).otherwise(whole).alias("content"), F.col("time_").alias("datetime"), F.col("tags_").alias("tags"),
        F.filter("links", fits).alias("links"), F.when(F.col("mode") == "searched", F.col("urls_")).when((F.col("mode") == "detail") | (F.col("mode") == "magnet"), F.array("id_")).alias("keys"),
    )


def details(scan: DataFrame) -> DataFrame:
    """``source, key, links`` and what result pages take their records from, of a scan of detail pages joined with the layouts; of a page captured twice one."""
    clips = F.filter(F.flatten(F.transform(of("link"), lambda e: F.array(e["attrs"]["href"], e["attrs"]["data-clipboard-text"]))), lambda u: u.isNotNull())
    names = F.filter(F.transform(of("link"), lambda e: F.struct(e["attrs"]["href"].alias("url"), trimmed(e["text"]).alias("name"))), lambda x: x["url"].isNotNull())
    raw = F.replace(F.coalesce("payload", F.lit("")), F.lit("\\/"), F.lit("/"))
    tokens = F.filter(F.transform(F.regexp_extract_all(raw, F.lit(r"eyJ[\w-]+\.[\w-]+\.[\w-]*"), F.lit(0)), token_url), lambda u: u.isNotNull())
    found = F.when(F.col("root").isNull(), F.concat(tokens, F.regexp_extract_all(raw, F.lit(ANY_URL), F.lit(0)))).otherwise(clips)
    told = F.filter(F.array(*[text_of(f"content {k}") for k in range(len(CONTENTS))]), lambda t: F.length(t) > LEAST_CONTENT)
    d = scan.where("error is null").withColumns({"found": found, "names": names, "told": told, "whole": trimmed(F.regexp_replace("root.text", r"\s+", " ")), "said": F.when(F.col("mode") == "searched", _said("a"))})
    filled = lambda c: F.nullif(c, F.lit(""))
    mine = F.when(F.col("source") == "panyq", F.slice(_plain(F.col("found")), 1, 1)).otherwise(F.filter(_plain(F.col("found")), lambda x: x["type"] != "others"))
    d = d.select(
        "source", _extracted(F.col("url"), "key").alias("key"), F.when(F.col("mode") == "searched", links_in(F.col("said"))).otherwise(mine).alias("found"), "names",
        F.coalesce(filled(attr_of("og", "content")), filled(text_of("h1")), text_of("page title")).alias("d_title"),
        F.substring(F.coalesce(F.get("told", F.lit(0)), F.col("whole")), 1, CONTENT_CHARS).alias("d_content"), F.coalesce(filled(attr_of("time", "datetime")), text_of("time")).alias("d_time"),
    )
    return d.where((F.size("found") > 0) & (F.col("key") != "")).dropDuplicates(["source", "key"])


def federated(scan: DataFrame, health: DataFrame, pages: DataFrame | None = None, chosen: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(records of all chosen healthy sources, warnings (source, message)).

    ``scan`` and ``pages`` (detail pages) are as ``captured`` reads them. Unhealthy sources, payloads that are no JSON and
    files that can't be read are warnings; the other sources go on. Repeated items of a source (by id, or title and link)
    that pools list count once.
    """
    spark = scan.sparkSession
    known = declarations(spark, chosen)
    alive = of_healthy(known, health)
    low = lambda df: df.withColumn("source", F.lower("source"))
    fit = low(scan).join(F.broadcast(alive), F.col("source") == F.col("name"))
    found = items(fit.where("error is null"))
    if pages is None:
        empty = "source string, key string, found " + LINKS + ", names array<struct<url:string,name:string>>, d_title string, d_content string, d_time string"
        more = spark.createDataFrame([], empty)
    else:
        more = details(low(pages).withColumn("source", F.regexp_replace("source", " detail$", "")).join(F.broadcast(alive.select("name", "mode", "key")), F.col("source") == F.col("name")))
    j = found.select("*", F.posexplode_outer(F.when((F.size("links") == 0) | (F.col("mode") == "searched"), F.col("keys"))).alias("k", "key")).join(more, ["source", "key"], "left")
    led = (F.col("mode") == "searched") & F.col("found").isNotNull()
    record = lambda i, title, content, time, links: F.struct(i.alias("id"), title.alias("title"), content.alias("content"), time.alias("datetime"), links.alias("links"))
    own = F.when((F.col("mode") == "searched") & (F.coalesce("k", F.lit(0)) == 0) & (F.size("links") > 0), F.array(record(F.concat(F.lit("direct-"), F.md5(F.col("asked").cast("binary"))), F.lit("Search Result"), F.col("content"), F.lit(""), F.col("links"))))
    one = F.when(led, F.array(record(F.md5(F.col("key").cast("binary")), F.coalesce(F.nullif("d_title", F.lit("")), F.concat(F.lit("Result "), (F.col("k") + 1).cast("string"))), F.col("d_content"), F.col("d_time"), F.col("found"))))
    each = F.when(F.col("each"), F.transform("found", lambda x, n: record(F.concat_ws("-", "id", n.cast("string")), F.coalesce(F.concat(F.lit("-"), F.nullif(F.get(F.filter("names", lambda y: y["url"] == x["url"]), F.lit(0))["name"], F.lit(""))), F.concat(F.lit("Result "), (n + 1).cast("string"))), F.lit(""), F.col("d_time"), F.array(x))))
    plain_id = F.when(F.col("id") != "", F.col("id")).otherwise(F.col("i").cast("string"))
    links = F.when(F.size("links") > 0, F.col("links")).otherwise(F.coalesce("found", _none()))
    other = F.when((F.size(links) > 0) | F.col("bare"), F.array(record(plain_id, F.col("title"), F.col("content"), F.col("datetime"), links)))
    none = F.filter(F.array(record(*[F.lit("")] * 4, _none())), lambda x: F.lit(False))
    made = F.when(F.col("mode") == "searched", F.concat(F.coalesce(own, none), F.coalesce(one, none))).when(F.col("each"), F.coalesce(each, none)).otherwise(F.coalesce(other, none))
    rows = j.select("source", "prefix", "tags", "i", F.explode(made).alias("r"))
    pooled = F.col("source") == "hunhepan"
    rows = rows.select(F.lit("").alias("message_id"), F.concat("prefix", F.lit("-"), "r.id").alias("unique_id"), F.lit("").alias("channel"), "r.datetime", "r.title", "r.content", "r.links", "tags", "source")
    if not chosen or "hunhepan" in {c.lower() for c in chosen}:
        rows = rows.withColumn("once", F.when(pooled, F.col("unique_id")).otherwise(F.monotonically_increasing_id().cast("string"))).dropDuplicates(["once"]).drop("once")
    sick = known.join(alive, "name", "left_anti").select(F.col("name").alias("source"), F.lit("unhealthy").alias("message"))
    bad = fit.where(F.col("error").isNotNull() | (F.col("payload").isNotNull() & F.try_parse_json("payload").isNull())).select("source", F.coalesce("error", F.lit("unreadable")).alias("message")).distinct()
    return rows, sick.unionByName(bad)
