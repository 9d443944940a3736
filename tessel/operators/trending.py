"""Trending terms from a log of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import admitted_term

#: Decay a day, days of the window, entries that are kept.
DECAY, WINDOW_DAYS, MAX_ENTRIES = 0.05, 7, 30


def counted(log: DataFrame) -> DataFrame:
    """``term, score, last_ts, created_ts`` of admitted terms. Terms are counted as they were typed first, so that only distinct ones are cleaned."""
    typed = log.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.min("ts").alias("first"))
    cleaned = typed.withColumn("term", admitted_term(F.col("term"))).where("term is not null")
    return cleaned.groupBy("term").agg(F.sum("n").alias("score"), F.max("last").alias("last_ts"), F.min("first").alias("created_ts"))


def _age_days(as_of: str):
    return (F.unix_millis(F.lit(as_of).cast("timestamp")) - F.unix_millis("last_ts")) / F.lit(86_400_000.0)


def trending(terms: DataFrame, as_of: str, limit: int = MAX_ENTRIES) -> DataFrame:
    """The top terms of the window by decayed score, with ``rank``, ``display_score`` and ``heat`` (percent of the first)."""
    decayed = F.col("score") * F.exp(-DECAY * _age_days(as_of))
    top = terms.where(_age_days(as_of) <= WINDOW_DAYS).withColumn("decayed", decayed).orderBy(F.desc("decayed"), "term").limit(min(limit, MAX_ENTRIES))
    order = Window.orderBy(F.desc("decayed"), "term")  # over the limited rows
    shown = F.round("decayed", 2)
    return top.select("term", "score", F.row_number().over(order).alias("rank"), shown.alias("display_score"), F.round(100 * shown / F.first(shown).over(order)).cast("long").alias("heat"))


def retained(terms: DataFrame, as_of: str, most: int = MAX_ENTRIES) -> DataFrame:
    """What retention leaves: terms of the window, and of these the best scores, the latest first."""
    return terms.where(_age_days(as_of) <= WINDOW_DAYS).orderBy(F.desc("score"), F.desc("last_ts"), "term").limit(most)


def top_by_score(terms: DataFrame, limit: int) -> DataFrame:
    return terms.orderBy(F.desc("score"), F.desc("last_ts"), "term").limit(limit)


def without_term(terms: DataFrame, term: str) -> DataFrame:
    """Terms without one; ``had_term`` tells whether it was there."""
    return terms.where(F.col("term") != term)


def had_term(terms: DataFrame, term: str) -> bool:
    return bool(terms.where(F.col("term") == term).limit(1).count())


def cleared(terms: DataFrame) -> DataFrame:
    return terms.limit(0)


def load_terms(stored: DataFrame, migrated: DataFrame) -> DataFrame:
    """Stored terms and migrated ones that are new."""
    return stored.unionByName(migrated.dropDuplicates(["term"]).join(stored.select("term"), "term", "left_anti"))
