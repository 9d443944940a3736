"""Drive links of texts by one automaton: hosts of all types are found in one pass, patterns run only where one stands.

The rules are those of ``urls.drive_links``, ``link_type`` and ``access_code``, which say them as columns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import urls
from .arrow import small_batches

ASCII = re.A
#: How far a link can begin before the text that tells its type, for all types but "any".
REACH = 32
SCHEME = re.compile(r"https?://")
#: What each of the automaton's texts has, or is followed by where a link is: it runs only within REACH of these.
ANCHORS = (".c", "magnet:?xt=", "ed2k://|")
TOLD = {kind: [h for h in hosts] for kind, hosts in urls.TYPE_HOSTS}


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    kinds: dict[str, list[str]] = {}
    for kind, literals in urls.NEEDED.items():
        for literal in literals:
            kinds.setdefault(literal.lower(), []).append(kind)
    for literal, of in kinds.items():
        found.add_word(literal, (len(literal), tuple(of)))
    found.make_automaton()
    return found


@cache
def _pattern(kind: str) -> re.Pattern:
    return re.compile(urls.ANY_LINK if kind == "any" else urls.LINK_PATTERNS[kind], ASCII)


@cache
def _unbracketed() -> re.Pattern:
    return re.compile(urls.LINK_PATTERNS["tianyi"].replace("(?:（[^）]*）)?", ""), ASCII)


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def _hits(text: str, low: str) -> dict[str, list[int]]:
    """Where the texts that links of a type have begin, by type."""
    found = {}
    for start, stop in _near(low):
        for end, (n, kinds) in _automaton().iter(low, start, stop):
            at = end - n + 1
            for kind in kinds:
                if kind == "any" or text[at : end + 1] == low[at : end + 1]:
                    found.setdefault(kind, []).append(at)
    return found


def _near(low: str) -> list[tuple[int, int]]:
    """What lies within REACH of an anchor, as separate spans in order."""
    places = []
    for anchor in ANCHORS:
        at = low.find(anchor)
        while at >= 0:
            places.append(at)
            at = low.find(anchor, at + 1)
    spans: list[tuple[int, int]] = []
    for at in sorted(places):
        start, stop = max(at - REACH, 0), min(at + REACH, len(low))
        if spans and start <= spans[-1][1]:
            spans[-1] = spans[-1][0], stop
        else:
            spans.append((start, stop))
    return spans


def _matches(kind: str, text: str, low: str, hits: list[int]) -> Iterator[str]:
    """The leftmost matches of a type's pattern that don't overlap; each holds a hit."""
    pattern, done = _pattern(kind), 0
    bracket = text.rfind("）") if kind == "tianyi" else -1  # after the last one, none is looked for again and again
    starts = [m.start() for m in SCHEME.finditer(low)] if kind == "any" else []
    for at in hits:
        if at < done:
            continue
        if kind in ("magnet", "ed2k"):
            tried = [at]
        elif kind == "any":
            k = bisect_right(starts, at) - 1
            tried = [starts[k]] if k >= 0 and starts[k] >= done else []
        else:
            tried, k = [], max(done, at - REACH)
            while (k := text.find("http", k, at)) >= 0:
                tried.append(k)
                k += 1
        for start in tried:
            if (m := (_unbracketed() if kind == "tianyi" and start > bracket else pattern).match(text, start)) is not None:
                done = m.end()
                yield m.group()
                break
            if kind == "any":
                done = max(done, start + 1)


ENDS = {kind: re.compile(f"(?<=.)(?:{ends})(?s:.*)$", ASCII) for kind, ends in urls.LINK_ENDS.items()}


def _decoded(url: str) -> str:
    return url if re.search(r"%(?![0-9A-Fa-f]{2})", url) else unquote(url, errors="replace")


def _cleaned(url: str, kind: str) -> str:
    cut = ENDS[kind].sub("", url) if kind in ENDS else url
    if kind == "tianyi":
        return _decoded(cut)
    schemed = lambda u: u if re.match("https?://", u) else "https://" + u
    if kind == "115":
        u = schemed(url)
        m = re.match(r"(.+?\?password=.{4})", u)
        return m[1] if m else re.sub(r"(?<=.)#.*$", "", u)
    if kind in ("123", "aliyun"):
        return schemed(cut).replace(urls.CODE_LABEL, "提取码")
    return cut.strip(" ") if kind == "mobile" else cut


def _bare(url: str) -> str:
    return re.sub("^.*?://", "", url.replace(urls.CODE_LABEL, "提取码"))


def drive_links(text: str) -> list[str]:
    """All drive links of a text, type by type, without repeats; of types whose links hold one another, without parts of others."""
    low = _lowered(text)
    hits, found, bares, known = _hits(text, low), [], [], set()
    for kind in (*urls.LINK_PATTERNS, "any"):
        for raw in _matches(kind, text, low, hits[kind]) if kind in hits else ():
            u = re.sub("https$", "", _cleaned(raw, kind))
            if not u:
                continue
            bare = _bare(u)
            if kind in urls.CONTAINED:
                again = u in found or any(u in y or y in u for y in found)
            elif kind in urls.CONTAINED_BARE:
                again = bare in known or any(bare in y or y in bare for y in bares)
            else:
                again = bare in known
            if not again:
                found.append(u)
                bares.append(bare)
                known.add(bare)
    return found


def link_type(url: str) -> str:
    u = url.lower()
    if "ed2k:" in u:
        return "ed2k"
    if u.startswith("magnet:"):
        return "magnet"
    return next((kind for kind, hosts in TOLD.items() if any(h in u for h in hosts)), "others")


BY_URL = {
    "tianyi": re.compile(r"(?:（访问码：|%EF%BC%88%E8%AE%BF%E9%97%AE%E7%A0%81%EF%BC%9A)([a-zA-Z0-9]+)(?:）|%EF%BC%89)"),
    "xunlei": re.compile(r"\?pwd=([a-zA-Z0-9]{4})"), "pwd": re.compile(r"(?i)[?&]pwd=([a-zA-Z0-9]{4})(?:[^a-zA-Z0-9]|$)", ASCII),
    "115": re.compile(r"password=([a-zA-Z0-9]{4})"), "123": re.compile(rf"(?:提取码|{urls.CODE_LABEL})[:：]([a-zA-Z0-9]+)"), "hosts 123": re.compile(urls.HOSTS_123),
    "scan": re.compile(urls.CODE_SCAN, ASCII), "baidu": re.compile(urls.CODE_BAIDU, ASCII), "label": re.compile(urls.CODE_AFTER_LABEL, ASCII),
}


class Codes:
    """Access codes of the links of one text; what the text itself tells is looked for once."""

    def __init__(self, text: str):
        self.text, self.told = text, {}

    def _said(self, rule: str) -> str:
        if rule not in self.told:
            m = BY_URL[rule].search(self.text) if "码" in self.text or rule != "scan" and "pwd" in self.text.lower() else None  # cheaper than the pattern
            self.told[rule] = m[1] if m else ""
        return self.told[rule]

    def of(self, url: str) -> str:
        rules = [("tianyi", "cloud.189.cn" in url), ("xunlei", "pan.xunlei.com" in url), ("pwd", True), ("115", any(h in url for h in ("115.com", "115cdn.com", "anxia.com"))), ("123", BY_URL["hosts 123"].search(url) is not None)]
        for rule, fits in rules:
            if fits and (m := BY_URL[rule].search(url)) and m[1]:
                return m[1]
        return self._said("scan") or ("pan.baidu.com" in url.lower() and self._said("baidu")) or self._said("label")


LINK = pa.struct([("type", pa.string()), ("url", pa.string()), ("password", pa.string())])
LINKS = "array<struct<type:string,url:string,password:string>>"


def links_of_text(text: str) -> list[dict[str, str]]:
    """Drive links of a text with types and access codes."""
    codes = Codes(text)
    return [{"type": link_type(u), "url": u, "password": codes.of(u)} for u in drive_links(text)]


@F.arrow_udf(ArrayType(StructType([StructField(name, StringType()) for name in ("type", "url", "password")])))
def _links(texts: pa.Array) -> pa.Array:
    return pa.array([links_of_text(value.as_py() or "") for value in texts], pa.list_(LINK))


def links_in(text: Column) -> Column:
    """Drive links of a text with types and access codes. Texts that can't have one (all hosts are of two domains) stay in the JVM."""
    small_batches(SparkSession.getActiveSession())
    return _links(F.when(text.rlike(r"(?i)\.c(?:om|n)|magnet:|ed2k:"), text))
