"""Survivors among records and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import link_titles
from ..functions.urls import canonical_key, link_type
from .rank import filled, order_key, record_key


def completeness(tags: str | None = None) -> Column:
    """How much a record tells, with a point for each of its ``tags`` if it has that column; null parts count nothing."""
    n_links = F.coalesce(F.size("links"), F.lit(0))
    n_links = F.greatest(n_links, F.lit(0))
    has = lambda c, n: F.when(filled(F.col(c)), n).otherwise(0)
    return has("unique_id", 10) + F.when(n_links > 0, n_links + 5).otherwise(0) + has("content", 3) + F.floor(F.length(F.coalesce("title", F.lit(""))) / 10).cast("int") + has("channel", 2) + (F.greatest(F.coalesce(F.size(tags), F.lit(0)), F.lit(0)) if tags else F.lit(0))


def survivors(records: DataFrame) -> DataFrame:
    """One record for each key; ``arrival_seq`` numbers the records of a side. Of side 0 the last arrival counts; side 1 replaces it, and each other, only if more complete.

    ``first_side`` and ``first_seq`` tell where the key came first. The aggregation combines before the shuffle.
    """
    tags = "tags" if "tags" in records.columns else None
    keyed = records.withColumns({"record_key": record_key(), "completeness": completeness(tags)})
    # who wins is decided on small rows; whole records are looked up by side and arrival
    slim = F.struct("side", "arrival_seq", "completeness")
    late = F.max(F.when(F.col("side") == 0, F.struct("arrival_seq", slim.alias("r"))))
    best = F.max(F.when(F.col("side") == 1, F.struct("completeness", (-F.col("arrival_seq")).alias("early"), slim.alias("r"))))
    first = F.min(F.struct("side", "arrival_seq"))
    g = keyed.groupBy("record_key").agg(late["r"].alias("a"), best["r"].alias("b"), first.alias("f"))
    pick = F.when(F.col("a").isNull() | (F.col("b.completeness") > F.col("a.completeness")), F.col("b")).otherwise(F.col("a"))
    won = g.select(F.col("record_key").alias("k"), pick.alias("r"), F.col("f.side").alias("first_side"), F.col("f.arrival_seq").alias("first_seq"))
    same = (keyed["record_key"] == won["k"]) & (keyed["side"] == won["r.side"]) & (keyed["arrival_seq"] == won["r.arrival_seq"])
    return keyed.join(won, same).drop("k", "r")


def exploded_links(ranked: DataFrame) -> DataFrame:
    """One row for each link of scored records, with its place ``at`` in the order of all links, key and type."""
    keep = [c for c in ranked.columns if c != "links"]
    e = ranked.select(*keep, F.posexplode("links").alias("link_pos", "link"))
    kind = F.when(filled(F.col("link.type")), F.lower("link.type")).otherwise(link_type(F.col("link.url")))
    return e.withColumns({"at": F.struct(order_key().alias("r"), "link_pos"), "url": F.col("link.url"), "password": F.coalesce("link.password", F.lit("")), "url_key": canonical_key(F.col("link.url")), "kind": kind} | ({"work_title": F.col("link.work_title")} if "work_title" in ranked.schema["links"].dataType.elementType.names else {})).drop("link")


def with_titles(records: DataFrame) -> DataFrame:
    """Records with ``titles``: link -> title, from their own content."""
    return records.withColumn("titles", link_titles(F.col("content"), F.transform("links", lambda l: l["url"])))


def with_notes(links: DataFrame, keyword: str = "") -> DataFrame:
    """Links with ``note``: their own ``work_title``, else the title that ``titles`` (link -> title, of the same record) has for the URL, else for a link that begins with it, else the record's. A note without the keyword gives way to a title that has it, unless the source skips the filter."""
    begins = F.get(F.filter(F.map_entries("titles"), lambda e: F.startswith(e["key"], F.col("url"))), F.lit(0))["value"]
    work = [F.nullif(F.col("work_title"), F.lit(""))] if "work_title" in links.columns else []
    own = F.coalesce(*work, F.nullif(F.try_element_at("titles", F.col("url")), F.lit("")), F.nullif(begins, F.lit("")), F.col("title"))
    has = lambda c: F.contains(F.lower(c), F.lit(keyword.lower()))
    skips = F.col("skip_filter") if "skip_filter" in links.columns else F.lit(False)
    return links.withColumn("note", F.when(F.lit(not keyword) | skips | has(own) | ~has(F.col("title")), own).otherwise(F.col("title")))


def named(links: DataFrame, platforms: DataFrame) -> DataFrame:
    """Links with the name and colour of their type; an unknown type is its own name. The dimension has a row for each type."""
    return links.join(F.broadcast(platforms), "link_type", "left").withColumn("platform", F.coalesce("platform", "link_type"))


def keyword_match(keyword: str, text: str = "title") -> Column:
    """Links whose title (or note) has the keyword, or whose source skips the filter."""
    return F.lit(not keyword) | F.col("skip_filter") | F.contains(F.lower(text), F.lit(keyword.lower()))


def latest_links(links: DataFrame, accepted: Column) -> DataFrame:
    """One link for each URL key: the newest accepted one, ties to the first; place and type are those of the key's first link, accepted or not."""
    row = F.struct("url", "password", "title", "event_ts", "label")
    newest = F.when(accepted, F.struct("ts_ms", F.struct(F.struct(-F.col("at.r.a"), -F.col("at.r.b"), -F.col("at.r.c")), -F.col("link_pos")).alias("first")))
    g = links.groupBy("url_key").agg(F.max_by(F.when(accepted, row), newest).alias("w"), F.min("at").alias("at"), F.min_by("kind", "at").alias("link_type"))
    return g.where("w is not null").select("url_key", "link_type", "at", "w.*")


def grouped(links: DataFrame) -> DataFrame:
    """The map shape: one row for each type with its links in order. For the edge, where groups are pages of results."""
    item = F.struct("at", F.struct("url", "password", F.col("title").alias("note"), "event_ts", F.col("label").alias("source")).alias("link"))
    return links.groupBy("link_type").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["link"]).alias("links"))


def union_merge(left: DataFrame, right: DataFrame, key: tuple = ("link_type", "url")) -> DataFrame:
    """Left rows, and of the right those whose key is new, the first of each; ``batch`` and ``pos`` order them."""
    first = Window.partitionBy(*key).orderBy("pos")
    fresh = right.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k").join(left.select(*key).distinct(), list(key), "left_anti")
    return left.withColumn("batch", F.lit(0)).unionByName(fresh.withColumn("batch", F.lit(1)))


def without_dead(links: DataFrame, dead: DataFrame, on: str = "url") -> DataFrame:
    return links.join(dead.select(on).distinct(), on, "left_anti")


def records_without_dead(records: DataFrame, dead: DataFrame) -> DataFrame:
    """Records without their dead links; those that had links and lost all go."""
    gone = dead.select(F.col("url").alias("dead_url")).distinct().withColumn("is_dead", F.lit(True))
    e = records.select("arrival_seq", F.posexplode_outer("links").alias("p", "l"))
    alive = e.join(gone, F.col("l.url") == F.col("dead_url"), "left").groupBy("arrival_seq").agg(F.array_sort(F.collect_list(F.when(F.col("is_dead").isNull() & F.col("l").isNotNull(), F.struct("p", "l")))).alias("k"), F.count("l").alias("n"))
    alive = alive.where("n = 0 or size(k) > 0").select("arrival_seq", F.transform("k", lambda x: x["l"]).alias("links"))
    return records.drop("links").join(alive, "arrival_seq")


def first_of_each(rows: DataFrame, order: str = "arrival_seq") -> DataFrame:
    """The first row of each resource: by ``disk_id``, else by link and name, else by name and type; combined before the shuffle."""
    both = F.when(filled(F.col("link")) | filled(F.col("name")), F.concat_ws("\x1f", F.lit("link"), F.coalesce("link", F.lit("")), F.coalesce("name", F.lit(""))))
    key = F.coalesce(F.when(filled(F.col("disk_id")), F.concat(F.lit("id\x1f"), "disk_id")), both, F.concat_ws("\x1f", F.lit("name"), F.coalesce("name", F.lit("")), F.coalesce("kind", F.lit(""))))
    return rows.groupBy(key.alias("resource")).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def of_latest_run(rows: DataFrame, key: str = "request", run: str = "run_id") -> DataFrame:
    """Rows of the latest run of each request; rows of runs that a later one overtook go."""
    latest = rows.groupBy(key).agg(F.max(run).alias("_latest"))
    return rows.join(latest, key).where(F.col(run) == F.col("_latest")).drop("_latest")
