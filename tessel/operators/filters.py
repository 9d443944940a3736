"""Filters of records and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import include_exclude
from ..functions.urls import link_type
from .rank import filled

#: Types that liveness can't check.
UNCHECKED = ("others", "unknown", "magnet", "ed2k")


def of_types(links: DataFrame, kinds: list[str] | None) -> DataFrame:
    return links if not kinds else links.where(F.lower("link_type").isin([k.strip().lower() for k in kinds]))


def of_sources(records: DataFrame, requested: list[str] | None, known: list[str] | None = None) -> DataFrame:
    """Records of the requested sources, in any case of letters; no names, or just all of the known ones, are no filter."""
    names = {n.lower() for n in requested or [] if n}
    if not names or known is not None and names == {k.lower() for k in known}:
        return records
    return records.where(F.lower("source").isin(sorted(names)))


def of_healthy(sources: DataFrame, health: DataFrame) -> DataFrame:
    """Sources (name) that no row of ``health`` (name, healthy) calls unhealthy."""
    bad = health.where("not healthy").select(F.lower("name").alias("bad")).distinct()
    return sources.join(bad, F.lower("name") == F.col("bad"), "left_anti")


def filter_links(links: DataFrame, include: list[str], exclude: list[str], text: str = "title") -> DataFrame:
    return links.where(include_exclude(F.col(text), include, exclude))


def filter_nested(records: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Records whose title passes, with those of their links whose own ``work_title`` (else the record's) passes; without links left they go."""
    named = "work_title" in records.schema["links"].dataType.elementType.names
    own = lambda l: F.coalesce(F.nullif(l["work_title"], F.lit("")), F.col("title")) if named else F.col("title")
    titled = F.filter("links", lambda l: include_exclude(own(l), include, exclude))
    return records.where(include_exclude(F.col("title"), include, exclude)).withColumn("links", titled).where(F.size("links") > 0)


def checkable(links: DataFrame) -> DataFrame:
    """The first of each URL that liveness can check."""
    kind = F.when(filled(F.col("link_type")), F.col("link_type")).otherwise(link_type(F.col("url")))
    return links.withColumn("link_type", kind).where(~kind.isin(*UNCHECKED)).groupBy("url").agg(F.min_by("link_type", "at").alias("link_type"), F.min("at").alias("at"))


def enabled_sources(known: DataFrame, enabled: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """``name`` of the known sources that are enabled, with those added since, in any case of letters; unknown names go."""
    asked = enabled if added is None else enabled.unionByName(added)
    return known.join(asked.select(F.lower("name").alias("asked")).distinct(), F.lower("name") == F.col("asked"), "left_semi")


def clamped(value: int | None, least: int, most: int, default: int) -> int:
    return default if value is None else min(max(value, least), most)


def expand_new(known: DataFrame, enabled: DataFrame) -> DataFrame:
    """Known sources that are not enabled yet."""
    return known.join(enabled.select("name"), "name", "left_anti")
