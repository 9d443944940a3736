"""Sources: the registry of table functions, and the shared transforms of captured payloads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.links import links_in
from ..functions.text import all_words, anchors, html_text, page_title

RECORD = "message_id string, unique_id string, channel string, datetime string, title string, content string, links array<struct<type:string,url:string,password:string>>"
#: Where JSON answers keep their rows, titles, texts, times and ids; rows of a channel's page and scan depths.
ARRAYS = ("data", "results", "list", "posts", "items", "records", "rows")
TITLES = ("title", "name", "share_title", "subject", "thread_title", "attributes.title", "attributes.name", "topic.title")
CONTENTS = ("content", "description", "blurb", "cooked", "content_html", "contentHtml", "text", "body", "attributes.content", "attributes.contentHtml")
TIMES = ("created_at", "createdAt", "time", "date", "published_at", "publishedAt", "attributes.createdAt", "attributes.created_at")
IDS = ("id", "share_id", "_id", "attributes.id")
SHALLOW, DEEP, FEW = 80, 160, 3


@dataclass(frozen=True)
class Source:
    """A source: captured payloads (source, payload) of ``name`` become records by ``transform``; None: by ``from_json`` or ``from_pages``."""

    name: str
    level: int = 3
    skip_filter: bool = False
    transform: Callable[..., DataFrame] | None = field(default=None, compare=False)


_sources: dict[str, Source] = {}


def register(source: Source | None) -> None:
    """The last registration of a name counts; None and sources without a name are ignored."""
    if source is not None and source.name:
        _sources[source.name] = source


def registered() -> list[Source]:
    return list(_sources.values())


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.name, s.level, s.skip_filter) for s in registered()], "name string, level int, skip_filter boolean")


def links_of(text: Column) -> Column:
    """Drive links of a text with types and access codes."""
    return links_in(text)


def _first(item: Column, paths) -> Column:
    return F.coalesce(*[F.nullif(F.try_variant_get(item, f"$.{p}", "string"), F.lit("")) for p in paths], F.lit(""))


def from_json(payloads: DataFrame, keyword: str = "") -> DataFrame:
    """Records of captured JSON (source, payload): rows are looked for at the top or in the usual fields; those without a drive link go."""
    v = F.try_parse_json("payload")
    arrays = [F.try_variant_get(v, "$", "array<variant>"), *[F.try_variant_get(v, f"$.{a}", "array<variant>") for a in ARRAYS]]
    fields = F.filter(F.map_values(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.expr("CAST(map() AS map<string,variant>)"))), lambda x: F.schema_of_variant(x).startswith("ARRAY"))
    other = F.try_variant_get(F.get(fields, F.lit(0)), "$", "array<variant>")
    rows = payloads.select("source", F.posexplode(F.coalesce(*arrays, other)).alias("i", "item"))
    content = _first(F.col("item"), CONTENTS)
    found = rows.select("source", "i", _first(F.col("item"), TITLES).alias("title"), content.alias("raw"), _first(F.col("item"), TIMES).alias("datetime"), _first(F.col("item"), IDS).alias("id"), links_of(F.concat(content, F.lit(" "), F.to_json("item"))).alias("links"))
    found = found.where(F.size("links") > 0)
    made = found.select(F.lit("").alias("message_id"), F.concat("source", F.lit("-"), F.when(F.col("id") != "", F.col("id")).otherwise(F.col("i").cast("string"))).alias("unique_id"), F.lit("").alias("channel"), "datetime", "title", html_text(F.col("raw")).alias("content"), "links")
    return made.where(all_words(F.lit(keyword), F.col("title"), F.col("content")))


def from_pages(pages: DataFrame, source: str, keyword: str = "", most: int | None = None) -> DataFrame:
    """Records of captured detail pages (url, html): title by precedence, links of anchors and text; ids are of the URL."""
    texts = F.concat(F.array_join(F.transform(anchors(F.col("html")), lambda a: F.concat(a["href"], F.lit("\n"), a["text"])), "\n"), F.lit("\n"), html_text(F.col("html")))
    made = pages.select(F.lit("").alias("message_id"), F.concat(F.lit(f"{source}-"), F.md5(F.col("url").cast("binary"))).alias("unique_id"), F.lit("").alias("channel"), F.lit("").alias("datetime"), page_title(F.col("html")).alias("title"), html_text(F.col("html")).alias("content"), links_of(texts).alias("links"))
    kept = made.where(F.size("links") > 0).where(all_words(F.lit(keyword), F.col("title"), F.col("content")))
    return kept.orderBy("unique_id").limit(most) if most else kept


def from_channels(messages: DataFrame, keyword: str = "", deep: bool | None = None) -> DataFrame:
    """Messages (channel, seq, text, links) of channels, the first of each up to the shallow limit; the deep one if there are few and the keyword is no single character."""
    at = F.row_number().over(Window.partitionBy("channel").orderBy("seq"))
    hit = messages.withColumn("k", at).where(all_words(F.lit(keyword), F.col("text")))
    shallow = hit.where(F.col("k") <= SHALLOW)
    if deep is None:
        deep = len(keyword) > 1 and shallow.limit(FEW).count() < FEW
    return (hit.where(F.col("k") <= DEEP) if deep else shallow).drop("k")


def joined_posts(posts: DataFrame, included: DataFrame) -> DataFrame:
    """JSON:API rows with what they refer to: posts (id, rel_id, ...) and included (id, attributes)."""
    return posts.join(included.select(F.col("id").alias("rel_id"), F.col("attributes").alias("related")), "rel_id", "left")


def zipped(kinds: Column, urls: Column, separator: str = "\\$\\$\\$") -> Column:
    """Two delimited lists side by side, as long as the shorter."""
    a, b = F.split(kinds, separator), F.split(urls, separator)
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("kind"), F.slice(b, F.lit(1), n).alias("url"))


def as_table_function(spark: SparkSession, name: str, view: str) -> None:
    """Makes ``name(keyword)`` a SQL table function over a view of records: those with all words of the keyword."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(keyword STRING) RETURNS TABLE (unique_id STRING, title STRING, content STRING)
        RETURN SELECT unique_id, title, content FROM {view} WHERE forall(filter(split(lower(keyword), '\\\\s+'), w -> w <> ''), w -> contains(lower(title), w) OR contains(lower(content), w))""")
