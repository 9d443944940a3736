"""Sources with layouts of their own, as declarations over captured payloads; all native.

Four families: JSON lists whose items hold links (side by side in two delimited lists, one in fields, or anywhere in
their text), pages of cards, tables of torrents, and result pages whose items are joined with captured detail pages.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_text, trimmed
from ..functions.urls import link_type, share_password
from ..operators.filters import of_healthy
from ..operators.merge import first_of_each

LINKS = "array<struct<type:string,url:string,password:string>>"
COLUMNS = ("message_id", "unique_id", "channel", "datetime", "title", "content", "links", "tags")
#: Hosts of types that only single sources know.
MORE_HOSTS = (("weiyun", "share.weiyun.com"), ("lanzou", "lanzou"), ("lanzou", "lanzo"), ("jianguoyun", "jianguoyun.com"))
#: What sources call the types of links.
SHORT_TYPES = {"BD": "baidu", "KG": "quark", "UC": "uc", "ALY": "aliyun", "XL": "xunlei", "TY": "tianyi", "115": "115", "MB": "mobile", "WY": "weiyun", "LZ": "lanzou", "JGY": "jianguoyun", "123": "123", "PK": "pikpak", "PIKPAK": "pikpak"}
DISK_TYPES = {"UCWP": "uc", "KKWP": "quark", "ALWP": "aliyun", "BDWP": "baidu", "123WP": "123", "115WP": "115", "TYWP": "tianyi", "XYWP": "xunlei", "WYWP": "weiyun", "LZWP": "lanzou", "JGYWP": "jianguoyun", "PKWP": "pikpak"}
POOL_TYPES = {"BDY": "baidu", "ALY": "aliyun", "QUARK": "quark", "TIANYI": "tianyi", "UC": "uc", "CAIYUN": "mobile", "115": "115", "XUNLEI": "xunlei", "123PAN": "123", "PIKPAK": "pikpak"}
ANY_URL = r"""https?://[^\s"'<>\]}\\]+|magnet:\?[^\s"'<>\\]+|ed2k://[^\s"'<>\\]+"""


def kind_of(url: Column) -> Column:
    """The type of a link, of the hosts too that only single sources know."""
    known, out = link_type(url), F.when(F.lit(False), "")
    for kind, host in MORE_HOSTS:
        out = out.when((known == "others") & F.contains(F.lower(url), F.lit(host)), kind)
    return out.otherwise(known)


def _link(kind: Column, url: Column, password: Column) -> Column:
    return F.struct(kind.alias("type"), url.alias("url"), F.coalesce(password, F.lit("")).alias("password"))


@dataclass(frozen=True)
class JsonList:
    """A list of items at the first of ``rows`` that there is; their fields by the first path that is filled.

    Links are the pairs of ``zipped`` (two fields, lists delimited by $$$), or that of ``url``, or all in ``text`` (or
    anywhere in the item, if that is empty). ``types`` maps the source's names of types; with ``agrees`` a link whose
    name says another type than its host goes. ``known_only`` drops links of unknown types, ``once`` repeated resources.
    """

    name: str
    rows: tuple[str, ...] = ("data", "data.list", "results", "list")
    title: tuple[str, ...] = ("title", "name")
    content: tuple[tuple[str, str], ...] = ()
    time: tuple[str, ...] = ()
    id: tuple[str, ...] = ("id",)
    tags: tuple[str, ...] = ()
    zipped: tuple[str, str] | None = None
    url: tuple[str, ...] = ()
    password: tuple[str, ...] = ()
    type: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    types: dict = field(default_factory=dict, hash=False)
    agrees: bool = False
    known_only: bool = False
    once: bool = False

    def records(self, payloads: DataFrame) -> DataFrame:
        v = F.try_parse_json("payload")
        items = F.coalesce(*[F.try_variant_get(v, f"$.{p}", "array<variant>") for p in self.rows], F.try_variant_get(v, "$", "array<variant>"))
        i = payloads.select(F.posexplode(items).alias("i", "item"))
        pick = lambda paths: F.coalesce(*[F.nullif(trimmed(F.try_variant_get("item", f"$.{p}", "string")), F.lit("")) for p in paths], F.lit(""))
        said = F.array_join(F.filter(F.array(*[F.when(pick((p,)) != "", F.concat(F.lit(label), pick((p,)))) for label, p in self.content]), lambda x: x.isNotNull()), " | ") if self.content else F.lit("")
        title = html_text(F.regexp_replace(pick(self.title), "</?(?:em|b|strong|i)>", ""))
        i = i.select("i", pick(self.id).alias("id"), title.alias("title"), said.alias("content"), pick(self.time).alias("datetime"), F.filter(F.array(*[pick((t,)) for t in self.tags]) if self.tags else F.expr("CAST(array() AS array<string>)"), lambda t: t != "").alias("tags"), self._links(pick).alias("links"))
        if self.once:
            keyed = i.withColumns({"disk_id": F.col("id"), "link": F.get("links", F.lit(0))["url"], "name": F.col("title"), "kind": F.get("links", F.lit(0))["type"]})
            i = first_of_each(keyed, "i").drop("disk_id", "link", "name", "kind")
        i = i.where(F.size("links") > 0)
        unique = F.concat(F.lit(self.name + "-"), F.when(F.col("id") != "", F.col("id")).otherwise(F.col("i").cast("string")))
        return i.select(F.lit("").alias("message_id"), unique.alias("unique_id"), F.lit("").alias("channel"), "datetime", "title", "content", "links", "tags")

    def _links(self, pick) -> Column:
        named = F.create_map(*[F.lit(x) for pair in self.types.items() for x in pair]) if self.types else None

        def typed(name: Column, url: Column) -> Column:
            if named is None:
                return kind_of(url)
            known = F.try_element_at(named, F.upper(trimmed(name)))
            return F.coalesce(F.when(F.lit(not self.agrees) | (known == kind_of(url)), known), F.when(known.isNull(), kind_of(url) if self.agrees else F.lit("others")), F.lit(""))

        if self.zipped:
            names, urls = (F.split(pick((p,)), r"\$\$\$") for p in self.zipped)
            n = F.least(F.size(names), F.size(urls))
            both = F.arrays_zip(F.slice(names, F.lit(1), n).alias("n"), F.slice(urls, F.lit(1), n).alias("u"))
            found = F.transform(both, lambda x: _link(typed(x["n"], trimmed(x["u"])), trimmed(x["u"]), share_password(trimmed(x["u"]), F.lit(""))))
        elif self.url:
            url = pick(self.url)
            own = pick(self.password) if self.password else F.lit("")
            found = F.array(_link(typed(pick(self.type), url) if self.type else kind_of(url), url, share_password(url, own)))
        else:
            text = pick(self.text) if self.text else F.replace(F.to_json("item"), F.lit("\\/"), F.lit("/"))
            found = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(ANY_URL), F.lit(0))), lambda u: _link(kind_of(u), u, share_password(u, F.lit(""))))
        kept = F.filter(found, lambda x: (x["url"] != "") & (x["type"] != "") & x["url"].rlike("^(?:https?:|magnet:|ed2k:)"))
        return F.filter(kept, lambda x: x["type"] != "others") if self.known_only else kept


def _parts(html: Column, mark: str) -> Column:
    """What follows each mark, up to the next."""
    return F.slice(F.split(html, mark), 2, 2**31 - 1)


def _text(pattern: str, part: str = "part") -> Column:
    return html_text(F.regexp_extract(part, pattern, 1))


@dataclass(frozen=True)
class Cards:
    """A page of cards: each begins at ``mark``; title and text by patterns; links are all drive links and magnets in it."""

    name: str
    mark: str
    title: str = r"(?is)<(?:h2|h3|h4)[^>]*>(.*?)</(?:h2|h3|h4)>"
    content: str = r"(?is)<p[^>]*>(.*?)</p>"

    def records(self, payloads: DataFrame) -> DataFrame:
        c = payloads.select(F.posexplode(_parts(F.col("payload"), self.mark)).alias("i", "part"))
        urls = F.array_distinct(F.transform(F.regexp_extract_all("part", F.lit(ANY_URL), F.lit(0)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))))
        links = F.filter(F.transform(urls, lambda u: _link(kind_of(u), u, share_password(u, F.lit("")))), lambda x: x["type"] != "others")
        c = c.select(F.concat(F.lit(self.name + "-"), F.col("i").cast("string")).alias("unique_id"), _text(self.title).alias("title"), _text(self.content).alias("content"), links.alias("links"))
        return _records(c.where((F.size("links") > 0) & (F.col("title") != "")))


@dataclass(frozen=True)
class Torrents:
    """A table of torrents, a row each: title and id by patterns, one magnet, and what its cells tell."""

    name: str
    title: str
    id: str
    cells: tuple[tuple[str, int], ...] = ()
    dots: bool = False

    def records(self, payloads: DataFrame) -> DataFrame:
        r = payloads.select(F.posexplode(_parts(F.col("payload"), r"(?i)<tr\b")).alias("i", "part"))
        magnet = F.replace(F.regexp_extract("part", r"(?i)href=\"(magnet:[^\"]+)\"", 1), F.lit("&amp;"), F.lit("&"))
        tds = F.transform(F.regexp_extract_all("part", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), html_text)
        told = F.array_join(F.filter(F.array(*[F.when(F.coalesce(F.get(tds, F.lit(k)), F.lit("")) != "", F.concat(F.lit(label), F.get(tds, F.lit(k)))) for label, k in self.cells]), lambda x: x.isNotNull()), " | ") if self.cells else F.lit("")
        title = _text(self.title)
        key = F.regexp_extract("part", self.id, 1)
        r = r.select(F.concat(F.lit(self.name + "-"), F.when(key != "", key).otherwise(title)).alias("unique_id"), (F.replace(title, F.lit("."), F.lit(" ")) if self.dots else title).alias("title"), told.alias("content"), magnet.alias("m"))
        return _records(r.where((F.col("m") != "") & (F.col("title") != "")).withColumn("links", F.array(_link(F.lit("magnet"), F.col("m"), F.lit("")))))


@dataclass(frozen=True)
class Details:
    """Cards of a result page, whose links stand on detail pages: both are joined on the id in their addresses."""

    name: str
    mark: str
    title: str
    id: str
    section: str = r"(?is)<body[^>]*>(.*)"
    content: str = r"(?is)<p[^>]*>(.*?)</p>"

    def records(self, payloads: DataFrame, pages: DataFrame) -> DataFrame:
        c = payloads.select(F.explode(_parts(F.col("payload"), self.mark)).alias("part"))
        c = c.select(F.regexp_extract("part", self.id, 1).alias("id"), _text(self.title).alias("title"), _text(self.content).alias("content")).where("id <> '' and title <> ''")
        said = F.coalesce(F.nullif(F.regexp_extract("html", self.section, 1), F.lit("")), F.col("html"))
        urls = F.array_distinct(F.transform(F.regexp_extract_all(said, F.lit(ANY_URL), F.lit(0)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))))
        links = F.filter(F.transform(urls, lambda u: _link(kind_of(u), u, share_password(u, F.lit("")))), lambda x: x["type"] != "others")
        d = pages.select(F.regexp_extract(F.concat(F.lit('"'), "url", F.lit('"')), self.id, 1).alias("page_id"), links.alias("links")).where((F.col("page_id") != "") & (F.size("links") > 0)).dropDuplicates(["page_id"])
        j = c.join(d, F.col("id") == F.col("page_id"))
        return _records(j.withColumn("unique_id", F.concat(F.lit(self.name + "-"), "id")))


def _records(rows: DataFrame) -> DataFrame:
    made = {"message_id": F.lit(""), "channel": F.lit(""), "datetime": F.lit(""), "tags": F.expr("CAST(array() AS array<string>)")}
    return rows.withColumns(made).select(*COLUMNS)


@dataclass(frozen=True)
class Posts:
    """JSON:API discussions, whose links stand in the included post that each refers to."""

    name: str

    def records(self, payloads: DataFrame) -> DataFrame:
        shape = "struct<data:array<struct<id:string,attributes:struct<title:string,createdAt:string>,relationships:struct<mostRelevantPost:struct<data:struct<id:string>>>>>,included:array<struct<id:string,attributes:struct<contentHtml:string,createdAt:string>>>>"
        p = payloads.select(F.from_json("payload", shape).alias("p")).select("p.data", F.map_from_entries(F.transform(F.coalesce("p.included", F.expr("CAST(array() AS array<struct<id:string,attributes:struct<contentHtml:string,createdAt:string>>>)")), lambda x: F.struct(x["id"], x["attributes"]))).alias("posts"))
        d = p.select(F.explode("data").alias("d"), "posts").withColumn("post", F.try_element_at("posts", F.col("d.relationships.mostRelevantPost.data.id")))
        links = F.transform(F.array_distinct(F.regexp_extract_all("post.contentHtml", F.lit(ANY_URL), F.lit(0))), lambda u: _link(kind_of(u), u, F.lit("")))
        d = d.select(F.concat(F.lit(self.name + "-"), "d.id").alias("unique_id"), F.col("d.attributes.title").alias("title"), F.lit("").alias("content"), F.coalesce("post.createdAt", "d.attributes.createdAt", F.lit("")).alias("datetime"), links.alias("links"))
        return _records(d.where(F.size("links") > 0)).drop("datetime").join(d.select("unique_id", "datetime"), "unique_id").select(*COLUMNS)


VOD = dict(rows=("list",), title=("vod_name",), id=("vod_id",), zipped=("vod_down_from", "vod_down_url"))
ABOUT = (("主演: ", "vod_actor"), ("导演: ", "vod_director"), ("地区: ", "vod_area"), ("年份: ", "vod_year"), ("状态: ", "vod_remarks"))
TITLED = r"(?is)<(?:h2|h3)[^>]*>\s*<a[^>]*>(.*?)</a>"
#: The sources with layouts of their own. Names, paths, classes.
CUSTOM = (
    JsonList("wanou", **VOD, content=ABOUT, tags=("vod_year", "vod_area"), types=SHORT_TYPES, agrees=True),
    JsonList("ouge", **VOD, content=ABOUT, tags=("vod_year", "vod_area"), types=SHORT_TYPES),
    JsonList("huban", **VOD, content=ABOUT, tags=("vod_year", "vod_area"), types=DISK_TYPES),
    JsonList("yunso", url=("url", "share_url"), time=("share_time", "created_at"), id=("full_id", "qid"), content=(("用户: ", "user"),), known_only=True),
    JsonList("xys", url=("url", "share_url"), time=("share_time", "created_at"), id=("full_id", "qid"), content=(("用户: ", "user"),), known_only=True),
    JsonList("meitizy", url=("url", "share_url"), time=("create_time",), known_only=True),
    JsonList("melost", url=("url", "share_url", "links[0].url"), password=("links[0].password",), time=("share_time",), id=("disk_id",), content=(("用户: ", "user"),)),
    JsonList("xdyh", title=("title", "name", "share_title"), content=(("", "content"), ("", "description")), time=("created_at", "time", "date"), known_only=True),
    JsonList("hunhepan", rows=("data.list",), title=("disk_name",), content=(("", "files"),), time=("shared_time",), id=("disk_id",), url=("link",), password=("disk_pass",), type=("disk_type",), types=POOL_TYPES, known_only=True, once=True),
    JsonList("pansearch", rows=("pageProps.data.data", "data"), title=("title", "name"), text=("content",), time=("time",), known_only=True),
    JsonList("panyq", rows=("data.hits", "data"), title=("title", "desc"), id=("eid",), url=("url", "link")),
    JsonList("mikuclub", rows=("posts", "data"), title=("title.rendered", "title"), time=("date",), known_only=True),
    JsonList("jsnoteclub", rows=("posts", "data"), title=("title",), text=("html",), time=("published_at",), known_only=True),
    JsonList("lingjisp", rows=("data", "list"), title=("title", "name"), id=("doub_id", "id"), known_only=True),
    Posts("pan666"),
    Cards("pioz", r'(?i)class="(?:resource-card|card|item|list-item)"'),
    Cards("u3c3", r'(?i)<(?:article|li)\b', title=r"(?is)<a[^>]*>(.*?)</a>"),
    Cards("xb6v", r'(?i)<(?:article|li)\b', title=TITLED),
    Torrents("thepiratebay", r'(?is)class="detLink"[^>]*>(.*?)</a>', r"/torrent/(\d+)", (("Seeders: ", 2), ("Leechers: ", 3)), dots=True),
    Torrents("nyaa", r'(?is)<a href="/view/\d+"[^>]*>(.*?)</a>', r"/view/(\d+)", (("Size: ", 3), ("Seeders: ", 5), ("Leechers: ", 6))),
    Torrents("1337x", r'(?is)<a href="/torrent/[^"]*"[^>]*>(.*?)</a>', r"/torrent/(\d+)"),
    Torrents("solidtorrents", r'(?is)<a href="/view/[^"]*"[^>]*>(.*?)</a>', r'/view/([^"/]+)'),
    Details("duoduo", r'(?i)class="module-search-item"', r"(?is)<h3[^>]*>\s*<a[^>]*>(.*?)</a>", r'/vod(?:/detail|detail)?/(?:id/)?(\d+)', r'(?is)id="download-list"[^>]*>(.*)'),
    Details("labi", r'(?i)class="module-search-item"', r"(?is)<h3[^>]*>\s*<a[^>]*>(.*?)</a>", r'/vod(?:/detail|detail)?/(?:id/)?(\d+)', r'(?is)id="download-list"[^>]*>(.*)'),
    Details("susu", r'(?i)class="post-list-item', TITLED, r"/(\d+)\.html"),
    Details("clxiong", r'(?i)class="col"', r"(?is)<h2[^>]*>(.*?)</h2>", r"/(?:drama|movie)/(\d+)", r'(?is)class="mv_down"[^>]*>(.*)'),
    Details("xiaozhang", r'(?i)class="list-boxes"', r'(?is)class="text_title_p"[^>]*>(.*?)</a>', r"/(\d+)\.html"),
)


def records_of(source, payloads: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Records of one source's captured payloads (source, payload); ``pages`` (source, url, html) are its detail pages."""
    mine = payloads.where(F.lower("source") == source.name)
    if isinstance(source, Details):
        return source.records(mine, pages.where(F.lower("source") == source.name)) if pages is not None else mine.select(*[F.lit(None).alias(c) for c in COLUMNS]).limit(0)
    return source.records(mine)


def federated(payloads: DataFrame, health: DataFrame, pages: DataFrame | None = None, chosen: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(records of all chosen healthy sources, warnings (source, message) of those that are unhealthy or whose payloads can't be read).

    A source that fails gives no records; the others go on. Payloads are read once for each source, so tables of
    captured payloads should be partitioned by source.
    """
    spark = payloads.sparkSession
    names = [s.name for s in CUSTOM if not chosen or s.name in {c.lower() for c in chosen}]
    known = spark.createDataFrame([(n,) for n in names], "name string")
    alive = of_healthy(known, health).select(F.col("name").alias("alive"))
    fit = payloads.join(F.broadcast(alive), F.lower("source") == F.col("alive"), "left_semi")
    found = None
    for s in CUSTOM:
        if s.name in names and (pages is not None or not isinstance(s, Details)):
            part = records_of(s, fit, pages)
            found = part if found is None else found.unionByName(part)
    sick = known.join(alive, F.col("name") == F.col("alive"), "left_anti").select(F.col("name").alias("source"), F.lit("unhealthy").alias("message"))
    json_names = [s.name for s in CUSTOM if isinstance(s, (JsonList, Posts))]
    broken = fit.where(F.lower("source").isin(*json_names) & F.try_parse_json("payload").isNull()).select(F.lower("source").alias("source"), F.lit("unreadable").alias("message")).distinct()
    return found, sick.unionByName(broken)
