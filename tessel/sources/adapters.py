"""Adapters that give the operators their inputs from the tables of a scale-factor folder.

Drive links don't occur in those tables, so they are derived by expressions that any SQL engine has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed clock: no operator reads the wall clock.
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search records, one for each document, with one link each."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    host = F.expr("CASE lang WHEN 'en' THEN 'pan.quark.cn' WHEN 'de' THEN 'pan.baidu.com' WHEN 'fr' THEN '115.com' ELSE 'www.alipan.com' END")
    url = F.concat(F.lit("https://"), host, F.lit("/s/"), F.substring(F.md5(F.col("text").cast("binary")), 1, 12), F.lit("?e="), F.col("doc_id").cast("string"))
    ts = F.when(F.col("doc_id") % 7 != 0, F.expr(f"TIMESTAMP '{AS_OF}' - make_dt_interval(CAST(doc_id % 500 AS INT))"))
    return d.select(
        F.col("doc_id").alias("arrival_seq"),
        F.lit("").alias("message_id"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("unique_id"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("").alias("channel"),
        ts.alias("event_ts"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("content"),
        F.array(F.struct(F.lit("").alias("type"), url.alias("url"), F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 4).alias("password"))).alias("links"),
        F.col("lang"),
        F.col("source"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source dimension: level and whether the keyword filter is skipped, by the number in the name."""
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return table(spark, sf_dir, "documents").select("source").where("source is not null").distinct().select(F.col("source").alias("name"), (1 + n % 4).alias("level"), (n % 10 == 0).alias("skip_filter"))


def duplicated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose keys collide where texts of a source are equal; side 0 came from channels, side 1 from plugins."""
    r = records(spark, sf_dir)
    key = F.concat("source", F.lit("-"), F.substring(F.md5(F.col("content").cast("binary")), 1, 8))
    return r.withColumns({"unique_id": key, "side": (F.col("arrival_seq") % 2).cast("int")})


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``term, ts``: what users searched for."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat("event_type", F.lit(" "), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("term"), F.col("ts").cast("timestamp").alias("ts"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, seq, ts_ms, ok, path``: events as requests of a user that fail or not."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").alias("path"))


#: The same derivations for another SQL engine.
SQL = {
    "records": f"""records AS (SELECT doc_id AS arrival_seq, source || '-' || doc_id AS unique_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS channel,
  CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(doc_id % 500 AS INTEGER)) END AS event_ts,
  substr(coalesce(text, ''), 1, 80) AS title, coalesce(text, '') AS content, lang, source,
  'https://' || CASE lang WHEN 'en' THEN 'pan.quark.cn' WHEN 'de' THEN 'pan.baidu.com' WHEN 'fr' THEN '115.com' ELSE 'www.alipan.com' END
    || '/s/' || substr(md5(coalesce(text, '')), 1, 12) || '?e=' || doc_id AS url, substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS password FROM documents)""",
    "sources": "sources AS (SELECT source AS name, 1 + CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 4 AS level, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 10 = 0 AS skip_filter FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))",
    "labelled": "labelled AS (SELECT *, CASE WHEN channel <> '' THEN 'tg:' || channel WHEN contains(unique_id, '-') THEN 'plugin:' || split_part(unique_id, '-', 1) ELSE 'unknown' END AS label FROM records)",
    "scored": f"""scored AS (SELECT l.*, coalesce(s.level, 3) AS level, coalesce(s.skip_filter, false) AS skip_filter,
  CASE WHEN event_ts IS NULL THEN 0 ELSE (SELECT CASE WHEN d <= 1 THEN 500 WHEN d <= 3 THEN 400 WHEN d <= 7 THEN 300 WHEN d <= 30 THEN 200 WHEN d <= 90 THEN 100 WHEN d <= 365 THEN 50 ELSE 20 END
    FROM (SELECT (epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(event_ts)) / 86400000.0 AS d)) END AS time_score,
  CASE WHEN contains(lower(title), '合集') THEN 490 WHEN contains(lower(title), '系列') THEN 420 WHEN contains(lower(title), '全') THEN 350 WHEN contains(lower(title), '完') THEN 280
    WHEN contains(lower(title), '最新') THEN 210 WHEN contains(lower(title), '附') THEN 140 WHEN contains(lower(title), 'complete') THEN 70 ELSE 0 END AS keyword_score,
  CASE coalesce(s.level, 3) WHEN 1 THEN 1000 WHEN 2 THEN 500 WHEN 4 THEN -200 ELSE 0 END AS source_score
  FROM labelled l LEFT JOIN sources s ON starts_with(l.label, 'plugin:') AND lower(substr(l.label, 8)) = lower(s.name))""",
    "ranked": "ranked AS (SELECT *, time_score + keyword_score + source_score AS total, coalesce(epoch_ms(event_ts), 0) AS ts_ms FROM scored)",
}


def sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
