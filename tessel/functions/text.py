"""Functions of titles, keywords, HTML and JSON texts, all as native columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import LINK_PATTERNS, decoded

#: White space of the records' origin, noise and separators of keywords, labels before titles.
WS = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
NOISE_ASCII = "4k|8k|720p|1080p|2160p|hdr|h265|x265|web-dl|webdl|bluray"
NOISE_CJK = "蓝光|杜比|国语|中字|双字|全集|完结"
BRACKETS = "[【】《》\\[\\]()（）]"
SEPARATORS = r"[\s/|,，、·:：;；!?？！+]+"
CONNECTORS = "[的之与和及]"
FORBIDDEN = "(?i)政治|暴力|色情|赌博|毒品|fuck|shit|bitch"
TITLE_LABELS = "^(?:名称：)?(?:标题：)?(?:片名：)?(?:名称:)?(?:标题:)?(?:片名:)?"
MAX_VARIANTS, MAX_TERM = 6, 20
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


#: The white space of WS.
SPACES = " " + "".join(map(chr, (*range(9, 14), 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def trim(text: str) -> str:
    """``trimmed`` of one text."""
    return text.strip(SPACES)


def collapse(text: str) -> str:
    """One text with a space for each run of white space, and none at the ends."""
    for c in SPACES[1:]:
        if c in text:
            text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip(" ")


def html_text(html: Column) -> Column:
    """The text of HTML: tags are white space, six references are decoded, runs of white space are one space."""
    c = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), "<[^>]+>", " ")
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return trimmed(F.regexp_replace(c, f"{WS}+", " "))


def anchors(html: Column) -> Column:
    """``array<struct<href,text>>`` of the anchors of HTML."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, r'(?is)href="([^"]*)"', 1).alias("href"), html_text(a).alias("text")))


def page_title(html: Column) -> Column:
    """Open-graph title, else first heading, else title."""
    pick = lambda p: F.nullif(html_text(F.regexp_extract(html, p, 1)), F.lit(""))
    return F.coalesce(pick(r'(?is)<meta\s+property="og:title"\s+content="([^"]*)"'), pick(r"(?is)<h1[^>]*>(.*?)</h1>"), pick(r"(?is)<title[^>]*>(.*?)</title>"), F.lit(""))


def normalised(keyword: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(keyword, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def keyword_variants(keyword: Column) -> Column:
    """At most six spellings of a keyword, without brackets, noise words and separators, and its parts; none is under two characters."""
    raw = trimmed(F.coalesce(keyword, F.lit("")))
    clean = F.regexp_replace(raw, BRACKETS, " ")
    clean = F.regexp_replace(clean, f"(?i)(?<![0-9A-Za-z_])(?:{NOISE_ASCII})(?![0-9A-Za-z_])", " ")
    clean = F.regexp_replace(clean, NOISE_CJK, " ")
    parts = F.filter(F.split(F.regexp_replace(clean, CONNECTORS, " "), SEPARATORS), lambda p: p != "")
    cjk = F.when(raw.rlike("[㐀-鿿]"), F.concat(F.when(F.size(parts) > 1, F.array(F.array_join(parts, " "))).otherwise(F.expr("CAST(array() AS array<string>)")), parts)).otherwise(F.expr("CAST(array() AS array<string>)"))
    tried = F.concat(F.array(raw, clean, F.regexp_replace(clean, SEPARATORS, " ")), cjk)
    fresh = lambda acc, v: F.when((F.length(normalised(v)) < 2) | F.exists(acc, lambda x: normalised(x) == normalised(v)), acc).otherwise(F.array_append(acc, trimmed(v)))
    return F.slice(F.aggregate(tried, F.expr("CAST(array() AS array<string>)"), fresh), 1, MAX_VARIANTS)


def matches_keyword(text: Column, keyword: Column) -> Column:
    """Whether a text has a variant of the keyword, spelling aside; blank keywords match all."""
    source = normalised(text)
    return (trimmed(keyword) == "") | ((source != "") & F.exists(keyword_variants(keyword), lambda v: F.contains(source, normalised(v))))


def all_words(keyword: Column, *fields: Column) -> Column:
    """Whether each word of the keyword is in one of the fields."""
    words = F.filter(F.split(F.lower(keyword), r"\s+"), lambda w: w != "")
    low = [F.lower(F.coalesce(f, F.lit(""))) for f in fields]
    hit = lambda w: F.contains(low[0], w) if len(low) == 1 else F.contains(low[0], w) | F.contains(low[1], w)
    return F.forall(words, hit)


def include_exclude(text: Column, include: list[str], exclude: list[str]) -> Column:
    """None of the excluded words, and one of the included if there are any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w)) if words else F.lit(False)
    return ~hit(exclude) & (hit(include) if include else F.lit(True))


def admitted_term(term: Column) -> Column:
    """A search term as it is counted; null if it isn't: blank, a link, too long or forbidden."""
    wide = "".join(chr(c) for a, b in (("A", "Z"), ("a", "z"), ("0", "9")) for c in range(ord(a) + 0xFEE0, ord(b) + 0xFEE1))
    ascii_ = "".join(chr(ord(c) - 0xFEE0) for c in wide)
    t = trimmed(term)
    ok = (t != "") & ~t.rlike("(?i)^https?://") & (F.length(t) <= MAX_TERM)
    t = F.translate(t, wide, ascii_)
    return F.when(ok & ~t.rlike(FORBIDDEN), t)


def safe_term(term: Column) -> Column:
    """What the write API takes: letters, digits, CJK and spaces, 50 at most."""
    t = trimmed(term)
    return t.rlike("^[一-龥a-zA-Z0-9 ]+$") & (F.length(t) <= 50)


def clean_title(title: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(title), TITLE_LABELS, ""), "[\\x{1F000}-\\x{1FFFF}\\x{2600}-\\x{27BF}]", ""))


def channel_title(first_line: Column) -> Column:
    """A message's first line without labels, marks and separators, 80 characters at most; the line itself if nothing is left."""
    labels = "(?:名称|描述|链接|大小|标签|夸克|UC|百度|阿里|迅雷|115|天翼|123|移动|提取码|密码|📧|📿|：|,|\\.|\\||-|\\s)+"
    t = F.substring(trimmed(F.regexp_replace(F.regexp_replace(first_line, labels, " "), r"\s+", " ")), 1, 80)
    return F.when(t != "", t).otherwise(F.substring(first_line, 1, 80))


def channel_content(text: Column, urls: Column) -> Column:
    """A message without its links and the names of drives."""
    bare = F.aggregate(urls, text, lambda t, u: F.replace(t, u, F.lit("")))
    return trimmed(F.regexp_replace(F.regexp_replace(bare, "(?:夸克|UC|百度|阿里|迅雷|115|天翼|123|移动|：|,|\\.|\\||-)+", ""), r"\s+", " "))


def cut_at(title: Column, words: list[str]) -> Column:
    """A title before the first of the words, unless it starts with it."""
    return trimmed(F.regexp_replace(title, "(?s)(?<=.)(?:" + "|".join(map(re.escape, words)) + ").*$", ""))


def chart_term(title: Column) -> Column:
    return trimmed(F.regexp_replace(title, "^【[^】]*】", ""))


def size_text(n_bytes: Column) -> Column:
    """Bytes with a unit, two decimals at most."""
    k = F.when(n_bytes > 0, F.least(F.floor(F.log(n_bytes.cast("double")) / F.log(F.lit(1024.0))), F.lit(4))).otherwise(0).cast("int")
    shown = F.round(n_bytes / F.pow(F.lit(1024.0), k), 2)
    return F.concat(F.regexp_replace(shown.cast("string"), r"\.0$", ""), F.lit(" "), F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")]), k + 1))


def token_url(token: Column) -> Column:
    """The ``data.url`` of a signed token's payload."""
    part = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.rpad(part, F.ceil(F.length(part) / 4).cast("int") * 4, "=")
    return F.get_json_object(F.decode(F.unbase64(padded), "UTF-8"), "$.data.url")


def upload_time(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(text, F.lit("MM-dd yyyy")), F.try_to_timestamp(text))


def age_label(ts: Column, as_of: str) -> Column:
    """How long ago, in words: today, yesterday, days under a week, thirties of days under a year, else the date."""
    days = F.floor((F.unix_millis(F.lit(as_of).cast("timestamp")) - F.unix_millis(ts)) / 86_400_000)
    return F.when(ts.isNull(), "").when(days <= 0, "今天").when(days == 1, "昨天").when(days < 7, F.concat(days.cast("string"), F.lit("天前"))).when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit("个月前"))).otherwise(F.date_format(ts, "yyyy-MM-dd"))


#: How lines of links begin; words that stand before links and are no titles; how titles of episodes end; labels that part a line into links; what ends a link there.
LINK_LINES = ("链接：", "地址：", "资源地址：", "网盘：", "网盘地址：", "链接:")
LINK_WORDS = (
    "链接 地址 资源地址 网盘 网盘地址 夸克 夸克网盘 quark 夸克云盘 百度 百度网盘 baidu 百度云 bdwp bdpan 迅雷 迅雷网盘 xunlei 迅雷云盘 115 115网盘 115云盘 123 123pan 123网盘 123云盘 "
    "阿里 阿里云 阿里云盘 aliyun alipan 阿里网盘 光鸭 光鸭云盘 光鸭网盘 guangya 天翼 天翼云 天翼云盘 tianyi 天翼网盘 uc uc网盘 uc云盘 移动 移动云 移动云盘 caiyun 彩云 pikpak pikpak网盘"
).split()
EPISODE = r"([^链地资网\s]+?(?:\([^)]+\))?(?:\s*\d+K)?(?:\s*臻彩)?(?:\s*MAX)?(?:\s*HDR)?(?:\s*更(?:新)?\d+集))$"
SPLITTERS = ("天翼链接：", "百度链接：", "夸克链接：", "阿里链接：", "UC链接：", "115链接：", "迅雷链接：", "123链接：", "链接：")
LINK_END = "[ 窃东迎千我恋将野合集天翼网盘(（]"
#: Types of links that part a single line.
PAIRED = ("tianyi", "baidu", "quark", "aliyun", "mobile", "uc", "123", "115", "xunlei")
LINK = r"https?://[^\s\"']+"
PAIRS = "array<struct<key:string,value:string>>"


def _none(kind: str) -> Column:
    return F.expr(f"CAST(array() AS {kind})")


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _is_link_line(line: Column) -> Column:
    hit = F.lit(False)
    for begin in LINK_LINES:
        hit = hit | F.startswith(F.lower(line), F.lit(begin))
    return hit


def _title_of_link_line(line: Column) -> Column:
    """What stands before the colon of a line with a link, unless it is part of a link or names a drive; null if there is none."""

    def before(colon: str) -> Column:
        part = F.substring_index(line, colon, 1)
        return F.when(F.contains(line, F.lit(colon)) & ~F.contains(part, F.lit("http")) & ~F.lower(trimmed(part)).isin(*LINK_WORDS), clean_title(part))

    return F.nullif(F.coalesce(before("："), before(":")), F.lit(""))


def _pairs_of_lines(text: Column) -> Column:
    """(link, title) by lines: a line's own title, else the last line without a link that stands before a line of links (or last)."""
    both = _let(F.transform(F.split(text, "\n"), trimmed), lambda lines: F.transform(lines, lambda line, i: F.struct(line.alias("line"), clean_title(line).alias("title"), _is_link_line(line).alias("links_only"), F.get(lines, i + 1).alias("next"))))

    def step(acc, x):
        line, follows = x["line"], x["next"]
        links = F.regexp_extract_all(line, F.lit(LINK), F.lit(0))
        title = F.when(x["links_only"], acc["last"]).otherwise(F.coalesce(_title_of_link_line(line), acc["last"]))
        more = F.when(title != "", F.concat(acc["pairs"], F.transform(links, lambda u: F.struct(u.alias("key"), title.alias("value"))))).otherwise(acc["pairs"])
        heads = follows.isNull() | _is_link_line(F.coalesce(follows, F.lit(""))) | F.coalesce(follows, F.lit("")).rlike(LINK)
        last = F.when(heads & (x["title"] != ""), x["title"]).otherwise(acc["last"])
        has = F.size(links) > 0
        return F.struct(F.when(has | (line == ""), acc["last"]).otherwise(last).alias("last"), F.when(has, more).otherwise(acc["pairs"]).alias("pairs"))

    return F.aggregate(both, F.struct(F.lit("").alias("last"), _none(PAIRS).alias("pairs")), step)["pairs"]


def _pairs_of_line(text: Column) -> Column:
    """(link, title) of a single line: what stands between a link and the one before; links that are repeated are part of it."""
    pattern = "(?s)(.*?)(" + "|".join(LINK_PATTERNS[k] for k in PAIRED) + ")"
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("link"))

    def title(part: Column) -> Column:
        t = trimmed(part)
        labelled = F.instr(t, "链接：") > 1
        return clean_title(F.when(labelled, F.substring_index(t, "链接：", 1)).otherwise(F.coalesce(F.nullif(F.regexp_extract(t, EPISODE, 1), F.lit("")), t)))

    def step(acc, x):
        again = F.array_contains(acc["seen"], decoded(x["link"]))
        part = F.concat(acc["pending"], x["before"])
        found = F.struct(x["link"].alias("key"), title(part).alias("value"))
        return F.struct(
            F.when(again, F.concat(part, x["link"])).otherwise("").alias("pending"),
            F.when(again, acc["seen"]).otherwise(F.array_append(acc["seen"], decoded(x["link"]))).alias("seen"),
            F.when(again | (found["value"] == ""), acc["pairs"]).otherwise(F.array_append(acc["pairs"], found)).alias("pairs"),
        )

    start = F.struct(F.lit("").alias("pending"), _none("array<string>").alias("seen"), _none(PAIRS).alias("pairs"))
    return F.aggregate(parts, start, step)["pairs"]


def _pairs_of_labels(text: Column, urls: Column) -> Column:
    """(link, title) of a single line without pairs: its parts between the first label that it has are the titles of its links, in order."""
    split = F.when(F.lit(False), _none("array<string>"))
    for label in SPLITTERS:
        split = split.when(F.contains(text, F.lit(label)), F.split(text, label))
    not_end = f"[^{LINK_END[1:]}"

    def titled(parts: Column) -> Column:
        inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
        rest = F.transform(F.filter(inner, lambda p: p.rlike(f"^{not_end}+{LINK_END}")), lambda p: clean_title(F.regexp_extract(p, f"(?s)^{not_end}+({LINK_END}.*)$", 1)))
        titles = F.concat(F.array(clean_title(parts[0])), rest)
        both = F.transform(urls, lambda u, i: F.struct(u.alias("key"), F.coalesce(F.get(titles, i), F.lit("")).alias("value")))
        return F.when((F.size(parts) > 1) & (F.size(urls) <= F.size(parts) - 1), F.filter(both, lambda x: x["value"] != "")).otherwise(_none(PAIRS))

    return _let(split, titled)


def link_titles(text: Column, urls: Column | None = None) -> Column:
    """Link -> title of a text: by lines if it has several, else by what stands before each link, else (given the ``urls`` of its record) by labels. The last title of a link counts; texts without a link have an empty map."""
    said = F.coalesce(text, F.lit(""))
    lined = F.contains(said, F.lit("\n"))
    pairs = F.when(~F.contains(said, F.lit("://")), _none(PAIRS)).when(lined, _pairs_of_lines(said)).otherwise(_pairs_of_line(said))
    if urls is not None:
        labelled = ~lined & (F.size(urls) > 0) & F.contains(said, F.lit("链接："))
        pairs = _let(pairs, lambda p: F.when((F.size(p) == 0) & labelled, _pairs_of_labels(said, urls)).otherwise(p))
    last = lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["key"] == x["key"]))
    return _let(pairs, lambda p: F.map_from_entries(last(p)))
