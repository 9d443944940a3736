"""Functions of drive-link URLs, all as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts of link types, in the order in which they are tried.
TYPE_HOSTS = (
    ("baidu", ("pan.baidu.com",)),
    ("quark", ("pan.quark.cn",)),
    ("aliyun", ("alipan.com", "aliyundrive.com")),
    ("guangya", ("guangyapan.com",)),
    ("tianyi", ("cloud.189.cn",)),
    ("uc", ("drive.uc.cn",)),
    ("mobile", ("caiyun.139.com", "yun.139.com", "caiyun.feixin.10086.cn")),
    ("115", ("115.com", "115cdn.com", "anxia.com")),
    ("pikpak", ("mypikpak.com",)),
    ("xunlei", ("pan.xunlei.com",)),
    ("123", ("123684.com", "123685.com", "123865.com", "123912.com", "123pan.com", "123pan.cn", "123592.com")),
)
#: Patterns of whole links, and of the part that names the resource (first match counts).
LINK_PATTERNS = {
    "baidu": r"https?://pan\.baidu\.com/s/[a-zA-Z0-9_-]+(?:\?pwd=[a-zA-Z0-9]{4})?",
    "tianyi": r"https?://cloud\.189\.cn/t/[a-zA-Z0-9]+(?:%[0-9A-Fa-f]{2})*(?:（[^）]*）)?",
    "uc": r"https?://drive\.uc\.cn/s/[a-zA-Z0-9]+(?:\?public=\d)?",
    "123": r"https?://(?:www\.)?123(?:684|865|685|912|pan|592)\.(?:com|cn)/s/[a-zA-Z0-9_-]+(?:\?(?:%E6%8F%90%E5%8F%96%E7%A0%81|提取码)[:：][a-zA-Z0-9]+)?",
    "115": r"https?://(?:115\.com|115cdn\.com|anxia\.com)/s/[a-zA-Z0-9]+(?:\?password=[a-zA-Z0-9]{4})?(?:#)?",
    "aliyun": r"https?://(?:www\.)?(?:alipan|aliyundrive)\.com/s/[a-zA-Z0-9]+",
    "guangya": r"https?://(?:www\.)?guangyapan\.com/s/[a-zA-Z0-9_-]+",
    "mobile": r"https?://(?:(?:www\.)?yun\.139\.com/shareweb/#/w/i/[a-zA-Z0-9]+|(?:www\.)?caiyun\.139\.com/(?:w/i/[a-zA-Z0-9]+|m/i\?[a-zA-Z0-9]+)[^\s<>\"']*|caiyun\.feixin\.10086\.cn/[a-zA-Z0-9]+)",
    "quark": r"https?://pan\.quark\.cn/s/[a-zA-Z0-9]+",
    "xunlei": r"https?://pan\.xunlei\.com/s/[a-zA-Z0-9]+(?:\?pwd=[a-zA-Z0-9]{4})?(?:#)?",
    "pikpak": r"https?://mypikpak\.com/s/[a-zA-Z0-9]+",
    "magnet": r"magnet:\?xt=urn:btih:[a-zA-Z0-9]+",
    "ed2k": r"ed2k://\|file\|[^|]+\|\d+\|[A-Fa-f0-9]+\|/?",
}
#: Links of hosts that no pattern above names, what a text with links of a type has, and types whose links repeat what contains them.
ANY_LINK = r"(?i)https?://(?:[\w.-]+\.)?(?:pan\.(?:baidu|quark)\.cn|(?:alipan|aliyundrive)\.com)(?:/[^\s'\"<>()]*)?"
NEEDED = {
    "baidu": ("pan.baidu.com/s/",), "tianyi": ("cloud.189.cn/t/",), "uc": ("drive.uc.cn/s/",), "123": ("123684", "123685", "123865", "123912", "123pan", "123592"), "115": ("115.com/s/", "115cdn.com/s/", "anxia.com/s/"),
    "aliyun": ("alipan.com/s/", "aliyundrive.com/s/"), "guangya": ("guangyapan.com/s/",), "mobile": ("139.com/", "10086.cn/"), "quark": ("pan.quark.cn/s/",), "xunlei": ("pan.xunlei.com/s/",), "pikpak": ("mypikpak.com/s/",),
    "magnet": ("magnet:?xt=urn:btih:",), "ed2k": ("ed2k://|file|",), "any": ("pan.baidu.cn", "pan.quark.cn", "alipan.com", "aliyundrive.com"),
}
CONTAINED, CONTAINED_BARE = ("quark", "xunlei"), ("magnet", "ed2k", "any")
KEY_PATTERNS = (
    r"https?://pan\.quark\.cn/s/[a-zA-Z0-9]+",
    r"https?://pan\.baidu\.com/s/[a-zA-Z0-9_-]+(?:\?pwd=[a-zA-Z0-9]{4})?",
    r"https?://(?:115\.com|115cdn\.com|anxia\.com)/s/[a-zA-Z0-9]+(?:\?password=[a-zA-Z0-9]{4})?",
    r"https?://(?:www\.)?123(?:684|865|685|912|pan|592)\.(?:com|cn)/s/[a-zA-Z0-9_-]+",
    r"https?://(?:www\.)?(?:alipan|aliyundrive)\.com/s/[a-zA-Z0-9]+",
    r"https?://pan\.xunlei\.com/s/[a-zA-Z0-9]+",
    r"https?://cloud\.189\.cn/t/[a-zA-Z0-9]+",
    r"https?://drive\.uc\.cn/s/[a-zA-Z0-9]+",
    r"https?://(?:www\.)?guangyapan\.com/s/[a-zA-Z0-9_-]+",
    r"https?://(?:www\.)?(?:yun\.139\.com/shareweb/#/w/i/[a-zA-Z0-9]+|caiyun\.139\.com/(?:w/i/[a-zA-Z0-9]+|m/i\?[a-zA-Z0-9]+)|caiyun\.feixin\.10086\.cn/[a-zA-Z0-9]+)",
    r"https?://mypikpak\.com/s/[a-zA-Z0-9]+",
)
#: Where cleaned links of each type end, and the share codes' percent-encoded label.
ENDS = r"[ \n\t，。；;,]"
LINK_ENDS = {"baidu": ENDS + r"|\?pwd=", "tianyi": ENDS + "|实时|天翼|更多", "uc": ENDS + "|网盘|123|夸克|阿里|百度", "mobile": ENDS + "|访问码|提取码|密码|链接|网盘", "123": ENDS + "|标签", "aliyun": ENDS + "|标签"}
CODE_LABEL = "%E6%8F%90%E5%8F%96%E7%A0%81"
HOSTS_123 = r"123684\.com|123685\.com|123865\.com|123912\.com|123pan\.com|123pan\.cn|123592\.com"


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def link_type(url: Column) -> Column:
    """The type of a link by the hosts it names; ``others`` if none."""
    u = F.lower(F.coalesce(url, F.lit("")))
    steps = F.when(F.contains(u, F.lit("ed2k:")), "ed2k").when(F.startswith(u, F.lit("magnet:")), "magnet")
    for kind, hosts in TYPE_HOSTS:
        any_host = F.lit(False)
        for h in hosts:
            any_host = any_host | F.contains(u, F.lit(h))
        steps = steps.when(any_host, kind)
    return steps.otherwise("others")


def host_type(url: Column) -> Column:
    """The type by host name alone; empty for unknown hosts and for messengers and proxies."""
    return type_of_host(host_of(url))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def type_of_host(host: Column) -> Column:
    steps = F.when((host == "t.me") | F.endswith(host, F.lit(".t.me")) | (host == "r.jina.ai"), "")
    more = {"tianyi": ("tianyi.cloud",), "mobile": ("pan.139.com",)}
    for kind, hosts in TYPE_HOSTS:
        any_host = F.lit(False)
        for h in (*hosts, *more.get(kind, ())):
            any_host = any_host | F.contains(host, F.lit(h))
        steps = steps.when(any_host, kind)
    return steps.otherwise("")


def canonical_key(url: Column) -> Column:
    """What names the resource: queries and fragments go, but for share codes that belong to it."""
    return F.coalesce(*[_found(url, p) for p in KEY_PATTERNS], url)


def unwrapped(url: Column) -> Column:
    """A link that a proxy's path or an ``url`` parameter carries, else the link itself."""
    return F.get(unwrapped_all(F.array(url)), F.lit(0))["url"]


def unwrapped_all(found: Column) -> Column:
    """``array<struct<url,kind>>`` of links: what each carries, or itself, and its type by host. Each step is bound, so that it is made once a link."""
    a = F.transform(found, lambda u: F.struct(u.alias("url"), host_of(u).alias("host"), decoded(F.try_parse_url(u, F.lit("QUERY"), F.lit("url"))).alias("inner")))
    b = F.transform(a, lambda x: F.struct(x["url"].alias("url"), type_of_host(x["host"]).alias("kind"), x["inner"].alias("inner"), host_of(x["inner"]).alias("inner_host"), F.when(x["host"] == "r.jina.ai", _found(decoded(x["url"]), r"^https?://r\.jina\.ai/(https?://.*)$", 1)).alias("bare")))
    c = F.transform(b, lambda x: F.coalesce(x["bare"], F.when((x["kind"] == "") & (type_of_host(x["inner_host"]) != ""), x["inner"]), x["url"]))
    d = F.transform(c, lambda u: F.struct(u.alias("url"), host_of(u).alias("host")))
    return F.transform(d, lambda x: F.struct(x["url"].alias("url"), type_of_host(x["host"]).alias("kind")))


def decoded(url: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone and what can't be decoded as it is."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def without_scheme(url: Column) -> Column:
    return F.regexp_replace(F.replace(url, F.lit(CODE_LABEL), F.lit("提取码")), "^.*?://", "")


def cleaned(url: Column, kind: str) -> Column:
    """A link of one type without what runs on after it."""
    cut = F.regexp_replace(url, f"(?<=.)(?:{LINK_ENDS[kind]})(?s:.*)$", "") if kind in LINK_ENDS else url
    if kind == "tianyi":
        return decoded(cut)
    if kind == "115":
        schemed = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
        return F.coalesce(_found(schemed, r"^(.+?\?password=.{4})", 1), F.regexp_replace(schemed, "(?<=.)#.*$", ""))
    if kind in ("123", "aliyun"):
        return F.replace(F.when(cut.rlike("^https?://"), cut).otherwise(F.concat(F.lit("https://"), cut)), F.lit(CODE_LABEL), F.lit("提取码"))
    return F.trim(cut) if kind == "mobile" else cut


def drive_links(text: Column, first_only: bool = False) -> Column:
    """All drive links of a text, type by type, without repeats; ``first_only``: the first of each type.

    A link of most types repeats one that is equal but for the scheme. Of the types in CONTAINED it also repeats one that
    it is part of, or that is part of it; of those in CONTAINED_BARE schemes don't count for that.
    """
    found = []
    for kind, pattern in (LINK_PATTERNS | {"any": ANY_LINK}).items():
        some = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        some = F.slice(some, 1, 1) if first_only else some
        said = F.lower(text) if kind == "any" else text
        some = F.when(_any(said, NEEDED[kind]), some).otherwise(F.expr("CAST(array() AS array<string>)"))  # cheaper than the pattern
        found.append(F.transform(some, _ruled(kind)))
    listed = F.filter(F.flatten(F.array(*found)), lambda x: x["u"] != "")

    def fresh(acc, x):
        u, bare = x["u"], without_scheme(x["u"])
        part = lambda a, b: F.contains(a, b) | F.contains(b, a)
        again = F.when(x["rule"] == 1, F.exists(acc, lambda y: part(y, u))).when(x["rule"] == 2, F.exists(acc, lambda y: part(without_scheme(y), bare))).otherwise(F.exists(acc, lambda y: without_scheme(y) == bare))
        return F.when(again, acc).otherwise(F.array_append(acc, u))

    return F.aggregate(listed, F.expr("CAST(array() AS array<string>)"), fresh)


def _ruled(kind: str):
    rule = 1 if kind in CONTAINED else 2 if kind in CONTAINED_BARE else 0
    return lambda u: F.struct(_cleaner(kind)(u).alias("u"), F.lit(rule).alias("rule"))


def _cleaner(kind: str):
    return lambda u: F.regexp_replace(cleaned(u, kind), "https$", "")


def is_supported(url: Column) -> Column:
    low, hit = F.lower(url), F.lit(False)
    for pattern in (*LINK_PATTERNS.values(), ANY_LINK):
        hit = hit | low.rlike(pattern)
    return hit


#: Labels of access codes in texts.
CODE_AFTER_LABEL = r"(?i)(?:(?:提取|访问|提取密|密)码|pwd)[：:]\s*([a-zA-Z0-9]{4})(?:[^a-zA-Z0-9]|$)"
CODE_BAIDU = r"(?i)(?:链接：.*?提取码：|密码：|提取码：|pwd=|pwd:|pwd：)([a-zA-Z0-9]{4})(?:[^a-zA-Z0-9]|$)"
CODE_SCAN = r"提取码[^提:：]*[:：]\s*([a-zA-Z0-9]{1,6})(?:[ \t\n\r，。；;,]|$)"


def access_code(content: Column, url: Column) -> Column:
    """The access code of a link: from the link by its type, then from the text; empty if there is none."""
    has = lambda *parts: _any(url, parts)
    by_url = [
        F.when(has("cloud.189.cn"), _found(url, r"(?:（访问码：|%EF%BC%88%E8%AE%BF%E9%97%AE%E7%A0%81%EF%BC%9A)([a-zA-Z0-9]+)(?:）|%EF%BC%89)", 1)),
        F.when(has("pan.xunlei.com"), _found(url, r"\?pwd=([a-zA-Z0-9]{4})", 1)),
        _found(url, r"(?i)[?&]pwd=([a-zA-Z0-9]{4})(?:[^a-zA-Z0-9]|$)", 1),
        F.when(has("115.com", "115cdn.com", "anxia.com"), _found(url, r"password=([a-zA-Z0-9]{4})", 1)),
        F.when(url.rlike(HOSTS_123), _found(url, rf"(?:提取码|{CODE_LABEL})[:：]([a-zA-Z0-9]+)", 1)),
    ]
    by_text = [_found(content, CODE_SCAN, 1), F.when(F.contains(F.lower(url), F.lit("pan.baidu.com")), _found(content, CODE_BAIDU, 1)), _found(content, CODE_AFTER_LABEL, 1)]
    return F.coalesce(*by_url, *by_text, F.lit(""))


def _any(text: Column, parts) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains(text, F.lit(p))
    return hit


def share_id(url: Column, kind: Column) -> Column:
    """The id that a link's type puts in its path; empty if there is none."""
    last = F.element_at(F.split(F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/|/$", ""), "/"), -1)
    return F.coalesce(
        F.when(kind == "xunlei", F.regexp_extract(url, r"pan\.xunlei\.com/s/([^?/#]+)", 1))
        .when(kind == "quark", F.regexp_extract(url, r"/s/([A-Za-z0-9]+)", 1))
        .when(kind == "baidu", F.coalesce(_found(url, r"^https?://[^/]+/s/([^?#]+)", 1), F.try_parse_url(url, F.lit("QUERY"), F.lit("surl"))))
        .when(kind == "tianyi", F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("code")), F.regexp_extract(url, r"/t/([^/?#]+)", 1)))
        .when(kind == "mobile", F.coalesce(_found(url, r"/w/i/([^&/?#]+)", 1), _found(url, r"/m/i\?([^&/?#]+)", 1), _found(url, r"feixin\.10086\.cn/([^&/?#]+)", 1)))
        .otherwise(last),
        F.lit(""),
    )


def normalised_share(kind: Column, url: Column, password: Column) -> Column:
    """Trimmed, without fragment, with a lower-case host, and with the access code for types that take it in the query."""
    base = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.coalesce(F.try_parse_url(base, F.lit("HOST")), F.lit(""))
    low = F.when(host != "", F.replace(base, host, F.lower(host))).otherwise(base)
    wants = kind.isin("baidu", "quark", "uc") & (F.coalesce(password, F.lit("")) != "") & F.try_parse_url(low, F.lit("QUERY"), F.lit("pwd")).isNull()
    return F.when(wants, F.concat(low, F.when(F.contains(low, F.lit("?")), "&").otherwise("?"), F.lit("pwd="), password)).otherwise(low)


#: What other services call the types.
TYPE_NAMES = {"bdy": "baidu", "baidupan": "baidu", "aly": "aliyun", "alipan": "aliyun", "ali": "aliyun", "kk": "quark", "kuake": "quark", "quarkpan": "quark", "xl": "xunlei", "xunleipan": "xunlei", "ty": "tianyi", "tianyiyun": "tianyi", "ucpan": "uc", "yd": "mobile", "caiyun": "mobile", "123pan": "123", "115pan": "115"}


def mapped_type(name: Column, url: Column) -> Column:
    """The type by another service's name for it, else by the link."""
    known = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    kinds = [k for k, _ in TYPE_HOSTS]
    return F.coalesce(F.when(low.isin(*kinds), low), F.try_element_at(known, low), link_type(url))


def first_token(text: Column) -> Column:
    """What comes before the first space or line end."""
    return F.regexp_extract(F.ltrim(text), r"^([^ \n\r]*)", 1)


def share_password(url: Column, fallback: Column) -> Column:
    """The access code that a link carries in its query or fragment, else the fallback."""
    return F.coalesce(_found(url, r"[?&#](?:pwd|password|passcode|code)=([^&#]+)", 1), _found(url, r"（访问码[：:]\s*([a-zA-Z0-9]+)）", 1), fallback, F.lit(""))
