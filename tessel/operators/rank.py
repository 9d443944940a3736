"""Scores and orders of search records."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (days at most, score); words of titles, the first found counts; score of a source level.
RECENCY = ((1, 500), (3, 400), (7, 300), (30, 200), (90, 100), (365, 50))
RECENCY_OLDER = 20
TITLE_WORDS = ("合集", "系列", "全", "完", "最新", "附", "complete")
LEVEL_SCORES = {1: 1000, 2: 500, 3: 0, 4: -200}
DEFAULT_LEVEL = 3


def filled(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c, F.lit("")) != ""


def millis(ts: Column) -> Column:
    return F.coalesce(F.unix_millis(ts), F.lit(0))


def record_key(unique_id: str = "unique_id", message_id: str = "message_id", title: str = "title", channel: str = "channel") -> Column:
    made = F.concat(F.lit("title_"), F.coalesce(title, F.lit("")), F.lit("_"), F.coalesce(channel, F.lit("")))
    return F.when(filled(F.col(unique_id)), F.col(unique_id)).when(filled(F.col(message_id)), F.col(message_id)).otherwise(made)


def source_label(channel_col: str = "channel", unique_id_col: str = "unique_id") -> Column:
    channel, unique_id = F.col(channel_col), F.col(unique_id_col)
    named = F.concat(F.lit("plugin:"), F.substring_index(unique_id, "-", 1))
    return F.when(filled(channel), F.concat(F.lit("tg:"), channel)).when(F.contains(F.coalesce(unique_id, F.lit("")), F.lit("-")), named).otherwise("unknown")


def recency_score(ts: Column, as_of: str) -> Column:
    """Buckets of fractional days; unknown times score 0, and future ones as the newest."""
    days = (F.unix_millis(F.lit(as_of).cast("timestamp")) - F.unix_millis(ts)) / F.lit(86_400_000.0)
    steps = F.when(ts.isNull(), 0)
    for most, score in RECENCY:
        steps = steps.when(days <= most, score)
    return steps.otherwise(RECENCY_OLDER)


def keyword_score(title: Column) -> Column:
    steps, low = F.when(title.isNull(), 0), F.lower(title)
    for k, word in enumerate(TITLE_WORDS):
        steps = steps.when(F.contains(low, F.lit(word)), (len(TITLE_WORDS) - k) * 70)
    return steps.otherwise(0)


def level_score(level: Column) -> Column:
    steps = F.when(level.isNull(), 0)
    for k, score in LEVEL_SCORES.items():
        steps = steps.when(level == k, score)
    return steps.otherwise(0)


def with_levels(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Records with ``label``, ``level`` and ``skip_filter``; the dimension has a row for each source and is broadcast only if small."""
    labelled = records.withColumn("label", source_label())
    name = F.when(F.startswith("label", F.lit("plugin:")), F.lower(F.expr("substr(label, 8)")))
    dim = sources.select(F.lower("name").alias("source_name"), "level", "skip_filter")
    joined = labelled.withColumn("source_name", name).join(dim, "source_name", "left").drop("source_name")
    return joined.withColumns({"level": F.coalesce("level", F.lit(DEFAULT_LEVEL)), "skip_filter": F.coalesce("skip_filter", F.lit(False))})


def scored(records: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """Records with the three partial scores, their total and ``ts_ms``."""
    r = with_levels(records, sources)
    r = r.withColumns({"time_score": recency_score(F.col("event_ts"), as_of), "keyword_score": keyword_score(F.col("title")), "source_score": level_score(F.col("level"))})
    return r.withColumns({"total": F.expr("time_score + keyword_score + source_score"), "ts_ms": millis(F.col("event_ts"))})


def order_key() -> Column:
    """Smaller goes first: higher total, newer, earlier arrival."""
    return F.struct((-F.col("total")).alias("a"), (-F.col("ts_ms")).alias("b"), F.col("arrival_seq").alias("c"))


def positions(df: DataFrame, coarse: list[Column], fine: list[Column], name: str = "rank", within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its 1-based place in the order of (coarse, fine), in all or ``within`` groups, without a window over all rows.

    Rows are counted by the coarse key; a window over those counts gives each key its offset, and rows are numbered
    inside their key. The coarse key must have boundedly many values; its order is ascending.
    """
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(coarse)]))
    before = Window.partitionBy(*within).orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(*within, "_key").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*within, "_key").orderBy(*fine)
    numbered = keyed.withColumn("_nth", F.row_number().over(inside))
    counts = counts.select(*[F.col(c).alias(f"_of_{c}") for c in (*within, "_key")], "_before")
    placed = numbered.join(counts, _null_safe((*within, "_key"))).withColumn(name, F.col("_before") + F.col("_nth"))
    return placed.drop("_key", "_before", "_nth", *[f"_of_{c}" for c in (*within, "_key")])


def by_name(df: DataFrame, column: str, ties: list[str], name: str = "rank", within: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """``df`` with its place in the order of names as Chinese readers sort them; ties by ``ties``.

    Collated names have no coarse key, so rows are sorted by ranges, which are kept, counted and numbered each.
    """
    key = F.collate(F.col(column), "zh")
    order = [*map(F.col, within), key.desc() if descending else key.asc(), *map(F.col, ties)]
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).persist(StorageLevel.DISK_ONLY)
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = ranges.withColumn("_nth", F.row_number().over(Window.partitionBy(*within, "_range").orderBy("_at")))
    return numbered.join(counts.select(*[counts[c].alias(f"_of_{c}") for c in (*within, "_range")], "_before"), _null_safe(within + ("_range",))).withColumn(name, F.col("_before") + F.col("_nth")).drop("_range", "_at", "_nth", "_before", *[f"_of_{c}" for c in (*within, "_range")])


def _null_safe(columns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return out


def by_rank(at: str = "at.r") -> tuple[list[Column], list[Column]]:
    """(coarse, fine) of an order key: total and day, then time and arrival."""
    return [F.col(f"{at}.a"), F.floor(F.col(f"{at}.b") / 86_400_000)], [F.col(f"{at}.b"), F.col(f"{at}.c")]


def ranked(records: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """Scored records with ``rank``: total descending, time descending, arrival."""
    day = F.floor(F.col("ts_ms") / 86_400_000)
    return positions(scored(records, sources, as_of), [-F.col("total"), -day], [F.desc("ts_ms"), F.col("arrival_seq")])


def quality_gate() -> Column:
    """Records worth showing: a known time, a title word, or a source of level 1 or 2."""
    return F.col("event_ts").isNotNull() | (F.col("keyword_score") > 0) | (F.col("level") <= 2)


def priority_first(channels: DataFrame, priority: list[str]) -> DataFrame:
    """Channels (name, ordinal) with ``arrival``: priority channels before the others, each in their order."""
    return positions(channels, [(~F.col("name").isin(*priority)).cast("int")], [F.col("ordinal")], name="arrival")
