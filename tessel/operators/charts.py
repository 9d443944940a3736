"""Ranked lists in pages, and rollups of health and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 20


def chart_title(score: Column, name: Column) -> Column:
    return F.concat(F.lit("【"), score.cast("string"), F.lit("】"), name)


def chart_text(types: Column, regions: Column) -> Column:
    """Types and regions, each joined, with a dot between; null if there are none."""
    joined = lambda a: F.nullif(F.array_join(a, " / "), F.lit(""))
    return F.nullif(F.concat_ws(" · ", joined(types), joined(regions)), F.lit(""))


def page_of(items: DataFrame, category: str, page: int, limit: int = PAGE) -> DataFrame:
    """A page of each category's items by position, with ``has_more``; a category is as long as its chart."""
    if page < 1 or not 1 <= limit <= 100:
        raise ValueError("page must be 1 at least, and limit from 1 to 100")
    n = F.count(F.lit(1)).over(Window.partitionBy(category))
    at = F.row_number().over(Window.partitionBy(category).orderBy("pos"))
    return items.withColumns({"rank": at, "has_more": n > page * limit}).where((F.col("rank") > (page - 1) * limit) & (F.col("rank") <= page * limit))


def warnings(errors: DataFrame) -> DataFrame:
    """``error_type, source, n, message``: counts, with the first message."""
    return errors.groupBy("error_type", "source").agg(F.count(F.lit(1)).alias("n"), F.min_by("message", "seq").alias("message"))


def last_errors(errors: DataFrame, most: int = 100) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("seq")))
    return errors.withColumn("k", at).where(F.col("k") <= most).drop("k")


def error_type(message: Column) -> Column:
    """What an error's message says: network, timeout, parse or unknown, in this order."""
    text = F.coalesce(message, F.lit(""))
    return F.when(text.rlike("network|ECONN|ENOTFOUND"), "NETWORK").when(text.rlike("timeout|超时"), "TIMEOUT").when(text.rlike("parse|解析|SyntaxError"), "PARSE").otherwise("UNKNOWN")


def severity(of_type: Column) -> Column:
    return F.when(of_type == "TIMEOUT", "LOW").when(of_type == "PARSE", "HIGH").otherwise("MEDIUM")


def health_counts(status: DataFrame) -> DataFrame:
    return status.agg(F.count(F.lit(1)).alias("total"), F.count_if("healthy").alias("healthy"), F.count_if(~F.col("healthy")).alias("unhealthy"))


def running_mean(outcomes: DataFrame) -> DataFrame:
    """``key, seq, mean``: the mean response of a key's successes so far."""
    so_far = Window.partitionBy("key").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return outcomes.where("ok").select("key", "seq", F.avg("response_ms").over(so_far).alias("mean"))
