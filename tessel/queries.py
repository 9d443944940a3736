"""The registered queries of the record operators, each beside the SQL of another engine that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text, urls
from .operators import charts, filters, liveness, merge, rank, trending
from .plans.search import Request, merged_links, results, search
from .sources import catalogue, channels, custom, registry
from .sources.adapters import AS_OF, attempts, duplicated_records, records, search_log, sources, sql, table
from .streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYWORD = "the"
RECORDS, RANKED = ("records",), ("records", "sources", "labelled", "scored", "ranked")
#: The links of the search in SQL: all, the winner of each key, and each key's first.
LINKS = f""",
links AS (SELECT *, regexp_extract(url, '^https://[^/]+/s/[a-zA-Z0-9]+') AS url_key, CASE lang WHEN 'en' THEN 'quark' WHEN 'de' THEN 'baidu' WHEN 'fr' THEN '115' ELSE 'aliyun' END AS kind,
  skip_filter OR contains(lower(title), '{KEYWORD}') AS accepted FROM ranked),
firsts AS (SELECT url_key, kind AS link_type, total AS f_total, ts_ms AS f_ts, arrival_seq AS f_seq FROM links QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY total DESC, ts_ms DESC, arrival_seq) = 1),
winners AS (SELECT * FROM links WHERE accepted QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY ts_ms DESC, total DESC, arrival_seq) = 1),
latest AS (SELECT w.*, f.link_type, f_total, f_ts, f_seq FROM winners w JOIN firsts f USING (url_key))
"""


def query(sql_text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql_text:
            SQL[f.__name__] = sql_text
        return f

    return add


def _scored(spark, sf_dir):
    return rank.scored(records(spark, sf_dir), sources(spark, sf_dir), AS_OF)


def _latest(spark, sf_dir):
    return merge.latest_links(merge.exploded_links(_scored(spark, sf_dir)), merge.keyword_match(KEYWORD))


def _placed(links):
    return rank.positions(links, *rank.by_rank(), name="pos", within=("link_type",))


def _dead(spark, sf_dir):
    """Links of documents whose labels say neither good nor clean."""
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    return records(spark, sf_dir).join(bad, F.col("arrival_seq") == F.col("doc_id"), "left_semi").select(F.explode("links.url").alias("url"))


@query(sql(*RANKED) + LINKS + "SELECT link_type, url, password, title AS note, epoch_ms(event_ts) AS event_ms, label AS source, row_number() OVER (PARTITION BY link_type ORDER BY f_total DESC, f_ts DESC, f_seq) AS pos FROM latest")
def search_grouped_links(spark, sf_dir):
    out = search(records(spark, sf_dir), sources(spark, sf_dir), Request(KEYWORD), AS_OF).links
    return _placed(out).select("link_type", "url", "password", F.col("title").alias("note"), F.unix_millis("event_ts").alias("event_ms"), F.col("label").alias("source"), "pos")


@query(sql(*RANKED) + "SELECT arrival_seq, label, level, total, row_number() OVER (ORDER BY total DESC, ts_ms DESC, arrival_seq) AS rank FROM ranked WHERE event_ts IS NOT NULL OR keyword_score > 0 OR level <= 2")
def search_results_ranked(spark, sf_dir):
    return results(records(spark, sf_dir), sources(spark, sf_dir), Request(KEYWORD, "results"), AS_OF).select("arrival_seq", "label", "level", "total", "rank")


COMPLETE = "10 + 6 + CASE WHEN content <> '' THEN 3 ELSE 0 END + CAST(floor(length(title) / 10) AS INTEGER) + CASE WHEN channel <> '' THEN 2 ELSE 0 END"


@query(sql(*RECORDS) + f""", d AS (SELECT *, source || '-' || substr(md5(content), 1, 8) AS record_key, arrival_seq % 2 AS side, {COMPLETE} AS completeness FROM records),
c AS (SELECT *, row_number() OVER (PARTITION BY record_key, side ORDER BY CASE WHEN side = 0 THEN -arrival_seq END, completeness DESC, arrival_seq) AS k FROM d),
best AS (SELECT * FROM c WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY completeness DESC, side) = 1),
f AS (SELECT record_key, side AS first_side, arrival_seq AS first_seq FROM d QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY side, arrival_seq) = 1)
SELECT record_key, arrival_seq, completeness, CAST(first_side AS INTEGER) AS first_side, first_seq FROM best JOIN f USING (record_key)""")
def survivor_merge(spark, sf_dir):
    return merge.survivors(duplicated_records(spark, sf_dir)).select("record_key", "arrival_seq", "completeness", "first_side", "first_seq")


@query(sql(*RECORDS) + f"SELECT arrival_seq, {COMPLETE} AS completeness FROM records")
def completeness_score(spark, sf_dir):
    return records(spark, sf_dir).select("arrival_seq", merge.completeness().alias("completeness"))


@query(sql(*RANKED) + "SELECT arrival_seq, time_score FROM ranked")
def recency_score(spark, sf_dir):
    return records(spark, sf_dir).select("arrival_seq", rank.recency_score(F.col("event_ts"), AS_OF).alias("time_score"))


TITLED = "CASE doc_id % 9 WHEN 0 THEN '合集' WHEN 1 THEN '系列' WHEN 2 THEN '全' WHEN 3 THEN '完' WHEN 4 THEN '最新' WHEN 5 THEN '附' WHEN 6 THEN 'COMPLETE' ELSE '' END"


@query(f"SELECT doc_id, CASE WHEN doc_id % 9 < 7 THEN (7 - doc_id % 9) * 70 ELSE 0 END AS keyword_score FROM (SELECT doc_id, {TITLED} AS title FROM documents)")
def keyword_priority_score(spark, sf_dir):
    titled = table(spark, sf_dir, "documents").select("doc_id", F.expr(TITLED).alias("title"))
    return titled.select("doc_id", rank.keyword_score(F.col("title")).cast("long").alias("keyword_score"))


@query(sql(*RANKED) + "SELECT arrival_seq, label, level, source_score, skip_filter FROM ranked")
def source_level_join(spark, sf_dir):
    return rank.with_levels(records(spark, sf_dir), sources(spark, sf_dir)).select("arrival_seq", "label", "level", rank.level_score(F.col("level")).alias("source_score"), "skip_filter")


@query(sql(*RANKED) + "SELECT arrival_seq FROM ranked WHERE event_ts IS NOT NULL OR keyword_score > 0 OR level <= 2")
def quality_gate(spark, sf_dir):
    return _scored(spark, sf_dir).where(rank.quality_gate()).select("arrival_seq")


@query(sql(*RECORDS) + "SELECT arrival_seq, regexp_extract(url, '^https://[^/]+/s/[a-zA-Z0-9]+') AS url_key FROM records")
def canonical_url_key(spark, sf_dir):
    return records(spark, sf_dir).select("arrival_seq", urls.canonical_key(F.col("links")[0]["url"]).alias("url_key"))


@query(sql(*RANKED) + LINKS + "SELECT url_key, url, epoch_ms(event_ts) AS event_ms FROM latest")
def latest_link_wins(spark, sf_dir):
    return _latest(spark, sf_dir).select("url_key", "url", F.unix_millis("event_ts").alias("event_ms"))


@query(sql(*RANKED) + LINKS + "SELECT url_key, link_type, f_seq AS first_seq FROM firsts")
def first_seen_type(spark, sf_dir):
    found = merge.latest_links(merge.exploded_links(_scored(spark, sf_dir)), F.lit(True))
    return found.select("url_key", "link_type", F.col("at.r.c").alias("first_seq"))


@query(sql(*RANKED) + LINKS + "SELECT link_type, count(*) AS n FROM latest GROUP BY ROLLUP (link_type)")
def group_counts_total(spark, sf_dir):
    return search(records(spark, sf_dir), sources(spark, sf_dir), Request(KEYWORD), AS_OF).totals


@query(sql(*RANKED) + LINKS + "SELECT url_key, title FROM latest WHERE (contains(lower(title), 'on') OR contains(lower(title), 'er')) AND NOT contains(lower(title), 'ing')")
def include_exclude_filter(spark, sf_dir):
    return filters.filter_links(_latest(spark, sf_dir), ["on", "er"], ["ing"]).select("url_key", "title")


@query(sql(*RECORDS) + "SELECT arrival_seq, url FROM records WHERE contains(lower(title), 'the') AND NOT contains(lower(title), 'ing')")
def nested_link_filter(spark, sf_dir):
    return filters.filter_nested(records(spark, sf_dir), ["the"], ["ing"]).select("arrival_seq", F.explode("links.url").alias("url"))


@query(sql(*RANKED) + LINKS + "SELECT url_key, link_type FROM latest WHERE link_type IN ('quark', '115')")
def cloud_type_filter(spark, sf_dir):
    return filters.of_types(_latest(spark, sf_dir), [" Quark", "115"]).select("url_key", "link_type")


@query(sql(*RECORDS) + "SELECT arrival_seq FROM records WHERE (contains(lower(title), 'the') OR contains(lower(content), 'the')) AND (contains(lower(title), 'and') OR contains(lower(content), 'and'))")
def all_words_filter(spark, sf_dir):
    return records(spark, sf_dir).where(text.all_words(F.lit("The  AND"), F.col("title"), F.col("content"))).select("arrival_seq")


DEAD = ", dead AS (SELECT DISTINCT url FROM records WHERE arrival_seq IN (SELECT doc_id FROM labels WHERE quality = 0))"


@query(sql(*RANKED) + LINKS + DEAD + "SELECT link_type, url FROM latest WHERE url NOT IN (SELECT url FROM dead)")
def dead_link_anti_join(spark, sf_dir):
    return merged_links(records(spark, sf_dir), sources(spark, sf_dir), Request(KEYWORD), AS_OF, _dead(spark, sf_dir)).select("link_type", "url")


@query(sql(*RECORDS) + DEAD + "SELECT arrival_seq, url FROM records WHERE url NOT IN (SELECT url FROM dead)")
def nested_dead_link_filter(spark, sf_dir):
    return merge.records_without_dead(records(spark, sf_dir), _dead(spark, sf_dir)).select("arrival_seq", F.explode("links.url").alias("url"))


@query(sql(*RANKED) + """, l AS (SELECT lang AS link_type, substr(md5(content), 1, 8) AS url, arrival_seq AS pos, arrival_seq % 2 AS side FROM records),
a AS (SELECT link_type, url, pos, 0 AS batch FROM l WHERE side = 0),
b AS (SELECT link_type, url, pos, 1 AS batch FROM l WHERE side = 1 AND (link_type, url) NOT IN (SELECT (link_type, url) FROM a) QUALIFY row_number() OVER (PARTITION BY link_type, url ORDER BY pos) = 1)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def client_union_merge(spark, sf_dir):
    l = records(spark, sf_dir).where("lang is not null").select(F.col("lang").alias("link_type"), F.substring(F.md5(F.col("content").cast("binary")), 1, 8).alias("url"), F.col("arrival_seq").alias("pos"))
    return merge.union_merge(l.where("pos % 2 = 0"), l.where("pos % 2 = 1"))


@query(sql(*RECORDS) + """SELECT arrival_seq AS id, CASE arrival_seq % 4 WHEN 0 THEN 'quark' WHEN 1 THEN 'others' WHEN 2 THEN '115' ELSE 'others' END AS link_type, url, CASE WHEN arrival_seq % 4 < 2 THEN password ELSE '' END AS password,
  CASE arrival_seq % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'T' ELSE '' END || CASE WHEN arrival_seq % 4 < 2 THEN '' || arrival_seq ELSE '' END AS note FROM records""")
def response_normalise(spark, sf_dir):
    """Answers of four shapes: grouped links, results with links, links as results, and a plain list."""
    n, l = F.col("arrival_seq").cast("string"), F.col("links")[0]
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    grouped = q('{"merged_by_type":{"quark":[{"url":"', l["url"], '","password":"', l["password"], '","note":"N', n, '"}]}}')
    nested = q('{"results":[{"title":"T', n, '","links":[{"url":"', l["url"], '","password":"', l["password"], '"}]}]}')
    flat = q('{"results":[{"type":"115","url":"', l["url"], '"}]}')
    payload = F.element_at(F.array(grouped, nested, flat, q('[{"url":"', l["url"], '"}]')), (F.col("arrival_seq") % 4).cast("int") + 1)
    return channels.from_answers(records(spark, sf_dir).select(F.col("arrival_seq").alias("id"), payload.alias("payload"))).select("id", "link_type", "url", "password", "note")


@query(sql(*RANKED) + LINKS + ", p AS (SELECT link_type, url, row_number() OVER (PARTITION BY link_type ORDER BY f_total DESC, f_ts DESC, f_seq) AS pos FROM latest) SELECT link_type, url, CAST(pos AS INTEGER) AS pos FROM p WHERE pos <= 3")
def group_preview_top3(spark, sf_dir):
    at = F.row_number().over(Window.partitionBy("link_type").orderBy("at"))
    return _latest(spark, sf_dir).withColumn("pos", at).where("pos <= 3").select("link_type", "url", "pos")


@query(sql(*RECORDS) + "SELECT arrival_seq, row_number() OVER (ORDER BY coalesce(event_ts, TIMESTAMP '1970-01-01') DESC, arrival_seq) AS rank FROM records")
def sort_by_date(spark, sf_dir):
    ms = rank.millis(F.col("event_ts"))
    return rank.positions(records(spark, sf_dir), [-F.floor(ms / 86_400_000)], [ms.desc(), F.col("arrival_seq")]).select("arrival_seq", "rank")


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY coalesce(text, '') COLLATE zh, doc_id) AS rank FROM documents")
def sort_by_name_zh(spark, sf_dir):
    named = table(spark, sf_dir, "documents").withColumn("name", F.coalesce("text", F.lit("")))
    return rank.by_name(named, "name", ["doc_id"], within=("lang",)).select("doc_id", "rank")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name COLLATE zh DESC, p_partkey) AS down, row_number() OVER (ORDER BY p_name COLLATE zh, p_partkey) AS up FROM part")
def sort_by_name_both_ways(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    down = rank.by_name(p, "p_name", ["p_partkey"], name="down", descending=True)
    return rank.by_name(down, "p_name", ["p_partkey"], name="up").select("p_partkey", "down", "up")


@query(sql(*RECORDS) + "SELECT arrival_seq, row_number() OVER (ORDER BY coalesce(event_ts, TIMESTAMP '1970-01-01'), arrival_seq) AS rank FROM records")
def sort_by_date_up(spark, sf_dir):
    ms = rank.millis(F.col("event_ts"))
    return rank.positions(records(spark, sf_dir).select("arrival_seq", "event_ts"), [F.floor(ms / 86_400_000)], [ms, F.col("arrival_seq")]).select("arrival_seq", "rank")


#: Links of all types by number, and the type of each.
HOSTED = "CASE doc_id % 13 WHEN 0 THEN 'https://PAN.baidu.com/s/1a' WHEN 1 THEN 'https://pan.quark.cn/s/1a' WHEN 2 THEN 'https://www.alipan.com/s/1a' WHEN 3 THEN 'https://guangyapan.com/s/1a' WHEN 4 THEN 'https://cloud.189.cn/t/1a' WHEN 5 THEN 'https://drive.uc.cn/s/1a' WHEN 6 THEN 'https://caiyun.139.com/m/i?1a' WHEN 7 THEN 'https://115cdn.com/s/1a' WHEN 8 THEN 'https://mypikpak.com/s/1a' WHEN 9 THEN 'https://pan.xunlei.com/s/1a' WHEN 10 THEN 'https://www.123pan.com/s/1a' WHEN 11 THEN 'magnet:?xt=urn:btih:1a' ELSE 'https://example.org/1a' END"
KINDS = "['baidu', 'quark', 'aliyun', 'guangya', 'tianyi', 'uc', 'mobile', '115', 'pikpak', 'xunlei', '123', 'magnet', 'others']"


@query(f"SELECT doc_id, {KINDS}[doc_id % 13 + 1] AS kind, CASE WHEN doc_id % 13 < 11 THEN {KINDS}[doc_id % 13 + 1] ELSE '' END AS by_host FROM documents")
def link_type_classify(spark, sf_dir):
    u = F.expr(HOSTED)
    return table(spark, sf_dir, "documents").select("doc_id", urls.link_type(u).alias("kind"), urls.host_type(u).alias("by_host"))


CODED = "'资源 https://pan.baidu.com/s/1' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) || ' 提取码：' || substr(md5(CAST(doc_id AS VARCHAR)), 9, 4) || ' 备用 https://pan.quark.cn/s/' || substr(md5(CAST(doc_id AS VARCHAR)), 13, 8) || CASE WHEN doc_id % 2 = 0 THEN ' https://pan.quark.cn/s/again' || doc_id ELSE '' END"


def _coded(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(CODED.replace("VARCHAR", "STRING")).alias("said"))


@query("SELECT doc_id, substr(md5(CAST(doc_id AS VARCHAR)), 9, 4) AS code, substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS from_url FROM documents")
def access_code_extract(spark, sf_dir):
    md5 = F.md5(F.col("doc_id").cast("string").cast("binary"))
    return _coded(spark, sf_dir).select("doc_id", urls.access_code(F.col("said"), F.lit("https://pan.quark.cn/s/1")).alias("code"), urls.access_code(F.col("said"), F.concat(F.lit("https://pan.baidu.com/s/1?pwd="), F.substring(md5, 1, 4))).alias("from_url"))


@query("""WITH m AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents)
SELECT doc_id, 'https://pan.baidu.com/s/1' || substr(h, 1, 8) AS url FROM m UNION ALL SELECT doc_id, 'https://pan.quark.cn/s/' || substr(h, 13, 8) FROM m
UNION ALL SELECT doc_id, 'https://pan.quark.cn/s/again' || doc_id FROM m WHERE doc_id % 2 = 0""")
def drive_link_extract(spark, sf_dir):
    return _coded(spark, sf_dir).select("doc_id", F.explode(urls.drive_links(F.col("said"))).alias("url"))


@query("SELECT doc_id, 'https://cloud.189.cn/t/a' || doc_id AS tianyi, 'https://115.com/s/a' || doc_id || '?password=ab12' AS p115, 'https://123pan.com/s/a' || doc_id AS p123 FROM documents")
def url_clean(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    join = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    return table(spark, sf_dir, "documents").select("doc_id", urls.cleaned(join("https://cloud.189.cn/t/a", n, "，更多"), "tianyi").alias("tianyi"), urls.cleaned(join("115.com/s/a", n, "?password=ab12#x"), "115").alias("p115"), urls.cleaned(join("123pan.com/s/a", n, " 标签"), "123").alias("p123"))


HTML_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({0}, '<br\s*/?>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'),
  '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '[\s\x{{A0}}\x{{3000}}]+', ' ', 'g'))"""


@query(f"SELECT page_id, md5({HTML_SQL.format('html')}) AS text_md5 FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_text(F.col("html")).cast("binary")).alias("text_md5"))


@query(f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>')) AS a FROM pages)
SELECT page_id, regexp_extract(a, '(?is)href="([^"]*)"', 1) AS href, {HTML_SQL.format('a')} AS text, count(*) AS n FROM a GROUP BY ALL""")
def html_anchors(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(text.anchors(F.col("html"))).alias("a"))
    return found.groupBy("page_id", F.col("a.href").alias("href"), F.col("a.text").alias("text")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, coalesce(nullif({HTML_SQL.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''), {HTML_SQL.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title FROM pages")
def page_title_precedence(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query("SELECT doc_id, md5(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', '', 'g')) AS keyword_md5 FROM documents")
def keyword_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalised(F.col("text")).cast("binary")).alias("keyword_md5"))


@query("""SELECT DISTINCT doc_id, unnest(CASE WHEN doc_id < 10 THEN ['【流浪地球】4K 蓝光电影的' || doc_id, '流浪地球    电影的' || doc_id, '流浪地球 电影 ' || doc_id, '流浪地球', '电影'] ELSE ['【流浪地球】4K 蓝光电影的' || doc_id, '流浪地球    电影的' || doc_id, '流浪地球 电影 ' || doc_id, '流浪地球', '电影', '' || doc_id] END) AS variant FROM documents""")
def keyword_variants(spark, sf_dir):
    word = F.concat(F.lit("【流浪地球】4K 蓝光电影的"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.keyword_variants(word)).alias("variant"))


TRIM = "regexp_replace({0}, '^[\\s\\x{{A0}}\\x{{3000}}]+|[\\s\\x{{A0}}\\x{{3000}}]+$', '', 'g')"


@query(f"""SELECT doc_id, md5({TRIM.format("coalesce(text, '')")}) AS title_md5, md5({TRIM.format("CASE WHEN strpos(text, ' the ') > 1 THEN substr(text, 1, strpos(text, ' the ') - 1) ELSE coalesce(text, '') END")}) AS cut_md5 FROM documents""")
def title_clean(spark, sf_dir):
    """Labels and pictures around whole texts go, and texts are cut at a word."""
    said, digest = F.coalesce("text", F.lit("")), lambda c: F.md5(c.cast("binary"))
    labelled = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("名称："), said, F.lit("🎬 "))).otherwise(F.concat(F.lit(" 片名:"), said))
    return table(spark, sf_dir, "documents").select("doc_id", digest(text.clean_title(labelled)).alias("title_md5"), digest(text.cut_at(said, [" the "])).alias("cut_md5"))


#: Texts of records with links: a title line, a title before a colon, a single line, and a whole text before the link.
SAID = """CASE doc_id % 4 WHEN 0 THEN '名称：A' || doc_id || chr(10) || '链接：' || url WHEN 1 THEN 'x' || chr(10) || 'B' || doc_id || '：' || url || chr(10) || 'y'
  WHEN 2 THEN 'C' || doc_id || ' ' || url || ' D 更新' || doc_id || '集 https://pan.xunlei.com/s/z' || doc_id ELSE '标题：' || coalesce(text, '') || chr(10) || '链接：' || url END"""
NOTED = "SELECT doc_id, 'https://pan.quark.cn/s/q' || doc_id AS url, text FROM documents"


@query(f"""WITH d AS ({NOTED}) SELECT doc_id, url, CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END || doc_id AS title FROM d WHERE doc_id % 4 < 3
UNION ALL SELECT doc_id, 'https://pan.xunlei.com/s/z' || doc_id, 'D 更新' || doc_id || '集' FROM d WHERE doc_id % 4 = 2
UNION ALL SELECT * FROM (SELECT doc_id, url, trim(regexp_replace(regexp_extract('标题：' || coalesce(text, ''), '[^\\n]*$'), '^标题：', '')) AS title FROM d WHERE doc_id % 4 = 3) WHERE title <> ''""")
def link_title_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("url", F.concat(F.lit("https://pan.quark.cn/s/q"), F.col("doc_id").cast("string")))
    return d.select("doc_id", F.explode(text.link_titles(F.expr(SAID.replace("doc_id ||", "CAST(doc_id AS STRING) ||")), F.array("url"))).alias("url", "title"))


@query(sql(*RANKED) + """, n AS (SELECT arrival_seq, regexp_extract(url, '^[^?]+') AS url, title, skip_filter OR contains(lower(note), 'b1') OR contains(lower(title), 'b1') AS accepted,
  CASE WHEN skip_filter OR contains(lower(note), 'b1') OR NOT contains(lower(title), 'b1') THEN note ELSE title END AS note
  FROM (SELECT *, CASE arrival_seq % 4 WHEN 0 THEN 'A' || arrival_seq WHEN 1 THEN 'B' || arrival_seq WHEN 2 THEN 'W' || arrival_seq ELSE title END AS note FROM ranked))
SELECT arrival_seq, url, note, accepted FROM n""")
def merged_notes(spark, sf_dir):
    """The title of each link: of its work, of its line, or of its record; and whether the keyword admits it."""
    url = F.regexp_extract(F.col("links")[0]["url"], r"^[^?]+", 0)
    n = F.col("arrival_seq").cast("string")
    said = F.when(F.col("arrival_seq") % 4 == 0, F.concat(F.lit("名称：A"), n, F.lit("\n链接："), url)).when(F.col("arrival_seq") % 4 == 1, F.concat(F.lit("B"), n, F.lit("："), url, F.lit("\nx"))).otherwise(F.col("content"))
    work = F.when(F.col("arrival_seq") % 4 == 2, F.concat(F.lit("W"), n))
    link = F.struct(F.lit("").alias("type"), url.alias("url"), F.col("links")[0]["password"].alias("password"), work.alias("work_title"))
    r = _scored(spark, sf_dir).withColumns({"content": said, "links": F.array(link)})
    noted = merge.with_notes(merge.exploded_links(merge.with_titles(r)), "b1")
    return noted.select("arrival_seq", "url", "note", merge.keyword_match("b1", "note").alias("accepted"))


@query(sql(*RANKED) + LINKS.replace("FROM ranked)", "FROM ranked WHERE lower(source) IN ('src1', 'src4'))") + "SELECT link_type, url FROM latest")
def source_subset(spark, sf_dir):
    return search(records(spark, sf_dir), sources(spark, sf_dir), Request(KEYWORD, sources=("src1", "SRC4")), AS_OF).links.select("link_type", "url")


@query(sql(*RECORDS) + """, w AS (SELECT *, CASE WHEN arrival_seq % 2 = 0 THEN 'the work ' || arrival_seq WHEN arrival_seq % 3 = 0 THEN 'nothing' ELSE '' END AS work FROM records)
SELECT arrival_seq, url FROM w WHERE contains(lower(title), 'the') AND NOT contains(lower(title), 'ing') AND (work = '' OR (contains(work, 'the') AND NOT contains(work, 'ing')) OR work IS NULL)""")
def nested_work_title(spark, sf_dir):
    n = F.col("arrival_seq")
    work = F.when(n % 2 == 0, F.concat(F.lit("the work "), n.cast("string"))).when(n % 3 == 0, "nothing").otherwise("")
    r = records(spark, sf_dir).withColumn("links", F.transform("links", lambda l: l.withField("work_title", work)))
    return filters.filter_nested(r, ["the"], ["ing"]).select("arrival_seq", F.explode("links.url").alias("url"))


@query(sql(*RECORDS) + f"SELECT arrival_seq, {COMPLETE} + arrival_seq % 4 AS completeness FROM records")
def completeness_with_tags(spark, sf_dir):
    tagged = records(spark, sf_dir).withColumn("tags", F.slice(F.array(*[F.lit(x) for x in "abc"]), F.lit(1), (F.col("arrival_seq") % 4).cast("int")))
    return tagged.select("arrival_seq", merge.completeness("tags").cast("long").alias("completeness"))


@query("""WITH m AS (SELECT doc_id, substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS h FROM documents)
SELECT doc_id, unnest(['https://pan.baidu.com/s/1' || h, 'https://pan.baidu.com/s/1' || h || 'x', 'https://pan.quark.cn/s/' || h, 'https://my.alipan.com/s/' || h]) AS url FROM m""")
def contained_links(spark, sf_dir):
    h = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8)
    parts = ("https://pan.baidu.com/s/1", " https://pan.baidu.com/s/1", "x https://pan.quark.cn/s/", " https://pan.quark.cn/s/", "yz https://my.alipan.com/s/", " http://my.alipan.com/s/")
    said = F.concat(*[c for p in parts for c in (F.lit(p), h)], F.lit("?x=1"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(urls.drive_links(said)).alias("url"))


@query("SELECT doc_id, unnest(['quark', 'baidu']) AS kind, unnest(['u1-' || doc_id, 'u2-' || doc_id]) AS url FROM documents")
def zip_join_links(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    both = registry.zipped(F.lit("quark$$$baidu$$$uc"), F.concat(F.lit("u1-"), n, F.lit("$$$u2-"), n))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(both).alias("z")).select("doc_id", "z.kind", "z.url")


@query(sql(*RECORDS) + "SELECT source || '-' || arrival_seq AS unique_id, 'T' || arrival_seq AS title, kind AS link_type, regexp_extract(url, '^[^?]+') AS url FROM (SELECT *, CASE lang WHEN 'en' THEN 'quark' WHEN 'de' THEN 'baidu' WHEN 'fr' THEN '115' ELSE 'aliyun' END AS kind FROM records)")
def json_autolocate(spark, sf_dir):
    n, key = F.col("arrival_seq").cast("string"), F.element_at(F.array(*[F.lit(k) for k in ("data", "list", "items", "found")]), (F.col("arrival_seq") % 4).cast("int") + 1)
    parts = [F.lit('{"n":1,"'), key, F.lit('":[{"title":"T'), n, F.lit('","content":"'), F.col("links")[0]["url"], F.lit('","id":"'), n, F.lit('"}]}')]
    found = registry.from_json(records(spark, sf_dir).select("source", F.concat(*parts).alias("payload")))
    return found.select("unique_id", "title", F.explode("links").alias("l")).select("unique_id", "title", F.col("l.type").alias("link_type"), "l.url")


@query("SELECT o_orderkey AS id, c_name AS related FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def jsonapi_join(spark, sf_dir):
    posts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("rel_id"))
    return registry.joined_posts(posts, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("attributes"))).select("id", "related")


@query("""WITH k AS (SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, * FROM documents)
SELECT source AS channel, doc_id AS seq FROM k WHERE k <= 80 AND contains(lower(coalesce(text, '')), 'the')""")
def channel_scan(spark, sf_dir):
    messages = table(spark, sf_dir, "documents").select(F.col("source").alias("channel"), F.col("doc_id").alias("seq"), "text")
    return registry.from_channels(messages, "the", deep=False).select("channel", "seq")


LOG = "log AS (SELECT event_type || ' ' || coalesce(json_extract_string(props, '$.k'), '') AS term, ts FROM events)"
TERMS = f"{LOG}, terms AS (SELECT trim(term) AS term, count(*) AS score, max(ts) AS last_ts, min(ts) AS created_ts FROM log WHERE length(trim(term)) BETWEEN 1 AND 20 GROUP BY 1)"
AGE = f"(epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(last_ts)) / 86400000.0"


def _terms(spark, sf_dir):
    return trending.counted(search_log(spark, sf_dir))


@query(f"WITH {TERMS} SELECT term, score, epoch_us(last_ts) // 1000 AS last_ms, epoch_us(created_ts) // 1000 AS created_ms FROM terms")
def term_admission(spark, sf_dir):
    return _terms(spark, sf_dir).select("term", "score", F.unix_millis("last_ts").alias("last_ms"), F.unix_millis("created_ts").alias("created_ms"))


TOP = f"top AS (SELECT term, score, score * exp(-0.05 * {AGE}) AS decayed FROM terms WHERE {AGE} <= 7 ORDER BY decayed DESC, term LIMIT 30), shown AS (SELECT term, score, CAST(row_number() OVER (ORDER BY decayed DESC, term) AS INTEGER) AS rank, round(decayed, 2) AS display_score FROM top)"


@query(f"WITH {TERMS}, {TOP} SELECT term, score, rank, display_score FROM shown")
def trending_decay(spark, sf_dir):
    return trending.trending(_terms(spark, sf_dir), AS_OF).drop("heat")


@query(f"WITH {TERMS} SELECT term, score FROM terms WHERE {AGE} <= 7 ORDER BY score DESC, last_ts DESC, term LIMIT 30")
def trending_retention(spark, sf_dir):
    return trending.retained(_terms(spark, sf_dir), AS_OF).select("term", "score")


@query(f"WITH {TERMS} SELECT count(*) AS total, CAST(sum(score) AS BIGINT) AS searches FROM terms")
def trending_stats(spark, sf_dir):
    return _terms(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.sum("score").alias("searches"))


@query(f"WITH {TERMS}, {TOP} SELECT term, CAST(round(100 * display_score / first(display_score) OVER (ORDER BY rank)) AS BIGINT) AS heat FROM shown")
def heat_percent(spark, sf_dir):
    return trending.trending(_terms(spark, sf_dir), AS_OF).select("term", "heat")


@query("""WITH i AS (SELECT p_brand AS category, p_partkey AS pos, '【' || p_size || '】' || p_name AS title FROM part),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY pos) AS INTEGER) AS rank, count(*) OVER (PARTITION BY category) > 40 AS has_more FROM i)
SELECT category, title, rank, has_more FROM r WHERE rank BETWEEN 21 AND 40""")
def chart_page(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("pos"), charts.chart_title(F.col("p_size"), F.col("p_name")).alias("title"))
    return charts.page_of(items, "category", 2).select("category", "title", "rank", "has_more")


@query("SELECT p_partkey, trim(p_name) AS term FROM part")
def chart_term(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.chart_term(charts.chart_title(F.col("p_size"), F.col("p_name"))).alias("term"))


#: Answers of checks by type and by what the labels say, in the order good, toxic, bad.
ANSWERS = (
    ("aliyun", '{"share_name":"x","file_count":2}', '{"code":"TooManyRequests"}', '{"code":"ShareLink.Cancelled"}'),
    ("123", '{"code":0}', '{"code":1,"data":{"HasPwd":true}}', '{"code":1,"message":"gone"}'),
    ("xunlei", '{"share_status":"OK"}', '{"error":"pass_code_empty"}', '{"share_status":"DELETED"}'),
    ("baidu", '{"list":{"errno":0,"list":[{"f":1}]}}', '{"list":{"errno":-9}}', '{"list":{"errno":105}}'),
    ("uc", "文件", "请输入密码", "链接已失效"),
    ("mobile", '{"resultCode":"0","data":{}}', '{"resultCode":"9","desc":"提取码错误"}', '{"resultCode":"200000727"}'),
    ("magnet", "", "", ""),
    ("quark", '{"token":{"code":0,"status":200,"data":{"stoken":"s"}},"detail":{"code":0,"data":{"list":[1],"share":{"status":1}}}}', '{"token":{"code":41008}}', '{"token":{"code":41010}}'),
    ("tianyi", "<shareVO><shareId>12</shareId></shareVO>", '{"res_message":"请输入访问码"}', "<error><code>ShareNotFound</code></error>"),
    ("115", '{"state":true,"errno":0,"data":{"count":2}}', '{"state":false,"error":"请输入访问码 receive_code"}', '{"state":false,"error":"链接已过期"}'),
)
STATES = {"aliyun": ("ok", "uncertain", "bad"), "magnet": ("unsupported",) * 3}


def _probes(spark, sf_dir):
    label = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 0).otherwise(2)
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.array(*[F.lit(x) for x in some]).alias("bodies")) for k, *some in ANSWERS])
    at = F.element_at(rows, (F.col("doc_id") % len(ANSWERS)).cast("int") + 1)
    return table(spark, sf_dir, "labels").select("doc_id", at["kind"].alias("kind"), F.lit(200).alias("http_status"), F.element_at(at["bodies"], label + 1).alias("body"))


STATE = f"list_extract(CASE doc_id % {len(ANSWERS)} " + " ".join(f"WHEN {i} THEN {list(STATES.get(k, ('ok', 'locked', 'bad')))}" for i, (k, *_) in enumerate(ANSWERS)) + " END, CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 ELSE 3 END)"


@query(f"SELECT doc_id, {STATE} AS state FROM labels")
def liveness_state(spark, sf_dir):
    return liveness.checked(_probes(spark, sf_dir), F.lit(0)).select("doc_id", "state")


@query(f"SELECT state, CASE state WHEN 'ok' THEN 86400000 WHEN 'bad' THEN 21600000 WHEN 'locked' THEN 43200000 WHEN 'unsupported' THEN 86400000 ELSE 1800000 END::BIGINT AS ttl_ms, count(*) AS n FROM (SELECT {STATE} AS state FROM labels) GROUP BY ALL")
def liveness_ttl(spark, sf_dir):
    p = liveness.checked(_probes(spark, sf_dir), F.lit(0))
    return p.groupBy("state", F.col("expires_at").alias("ttl_ms")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE user_id % 3 WHEN 0 THEN 'NETWORK' WHEN 1 THEN 'TIMEOUT' ELSE 'UNKNOWN' END AS error_type, 'global' AS source, count(*) AS n, min_by(CASE user_id % 3 WHEN 0 THEN 'network failed' WHEN 1 THEN 'request timeout' ELSE 'odd' END || ' ' || event_id, event_id) AS message FROM events WHERE event_type = 'error' GROUP BY ALL")
def warning_rollup(spark, sf_dir):
    kind = F.when(F.col("user_id") % 3 == 0, "network failed").when(F.col("user_id") % 3 == 1, "request timeout").otherwise("odd")
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.lit("global").alias("source"), F.col("event_id").alias("seq"), F.concat(kind, F.lit(" "), F.col("event_id").cast("string")).alias("message"))
    return charts.warnings(e.withColumn("error_type", charts.error_type(F.col("message"))))


@query("WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'error') < 5 AS healthy FROM events GROUP BY user_id) SELECT count(*) AS total, count(*) FILTER (healthy) AS healthy, count(*) FILTER (NOT healthy) AS unhealthy FROM s")
def health_counts(spark, sf_dir):
    return charts.health_counts(attempts(spark, sf_dir).groupBy("key").agg((F.count_if(~F.col("ok")) < 5).alias("healthy")))


@query("SELECT user_id AS key, event_id AS seq, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS mean FROM events WHERE event_type <> 'error'")
def health_running_mean(spark, sf_dir):
    a = attempts(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("value").alias("response_ms")), "seq")
    return charts.running_mean(a).withColumn("mean", F.round("mean", 9))


DAY = 86_400_000
EVENTS = "e AS MATERIALIZED (SELECT user_id AS key, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events)"


@query(f"""WITH RECURSIVE {EVENTS}, r AS (
SELECT key, seq, ts_ms, k, 1 AS n, ts_ms + {DAY} AS until FROM e WHERE k = 1 UNION ALL
SELECT e.key, e.seq, e.ts_ms, e.k, CASE WHEN e.ts_ms > r.until THEN 1 ELSE r.n + 1 END, CASE WHEN e.ts_ms > r.until THEN e.ts_ms + {DAY} ELSE r.until END FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
SELECT key, seq, ts_ms, n <= 3 AS allowed FROM r""")
def rate_limit_anchored(spark, sf_dir):
    return state.replay(attempts(spark, sf_dir), state.RateLimit(3, DAY))


@query(f"""WITH RECURSIVE {EVENTS}, r AS (
SELECT key, seq, ts_ms, k, CASE WHEN ok THEN 0 ELSE 1 END AS n, CAST(-1 AS BIGINT) AS until, true AS allowed FROM e WHERE k = 1 UNION ALL
SELECT e.key, e.seq, e.ts_ms, e.k,
  CASE WHEN r.until >= 0 AND e.ts_ms < r.until THEN r.n WHEN e.ok THEN 0 WHEN r.until >= 0 THEN 1 ELSE r.n + 1 END,
  CASE WHEN r.until >= 0 AND e.ts_ms < r.until THEN r.until WHEN e.ok THEN -1 WHEN (CASE WHEN r.until >= 0 THEN 1 ELSE r.n + 1 END) >= 2 THEN e.ts_ms + {2 * DAY} ELSE -1 END,
  NOT (r.until >= 0 AND e.ts_ms < r.until) FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
SELECT key, seq, ts_ms, allowed FROM r""")
def lockout_replay(spark, sf_dir):
    return state.replay(attempts(spark, sf_dir), state.Lockout(2, 2 * DAY))


@query(f"""WITH RECURSIVE {EVENTS}, r AS (
SELECT key, seq, ts_ms, k, CASE WHEN ok THEN 0 ELSE 1 END AS n, CASE WHEN ok THEN -1 ELSE ts_ms END AS last, true AS allowed FROM e WHERE k = 1 UNION ALL
SELECT e.key, e.seq, e.ts_ms, e.k,
  CASE WHEN e.ok AND r.n >= 2 AND e.ts_ms - r.last < {2 * DAY} THEN r.n WHEN e.ok THEN 0 WHEN r.n >= 2 AND e.ts_ms - r.last >= {2 * DAY} THEN 1 ELSE r.n + 1 END,
  CASE WHEN e.ok THEN r.last ELSE e.ts_ms END, NOT (r.n >= 2 AND e.ts_ms - r.last < {2 * DAY}) FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
SELECT key, seq, ts_ms, allowed FROM r""")
def breaker_replay(spark, sf_dir):
    return state.replay(attempts(spark, sf_dir), state.Breaker(2, 2 * DAY))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT CAST(user_id % 8 AS VARCHAR) AS namespace, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, event_id % 3 = 0 AS is_set, event_type AS key,
  row_number() OVER (PARTITION BY user_id % 8 ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
r AS (SELECT namespace, seq, key, k, is_set, false AS hit, CASE WHEN is_set THEN [{{'key': key, 'until': ts_ms + {DAY}}}] ELSE [] END AS held FROM e WHERE k = 1
UNION ALL SELECT e.namespace, e.seq, e.key, e.k, e.is_set, NOT e.is_set AND len(list_filter(r.held, lambda x: x.key = e.key AND x.until > e.ts_ms)) > 0,
  CASE WHEN e.is_set THEN list_append(list_slice(list_filter(r.held, lambda x: x.key <> e.key AND x.until > e.ts_ms), greatest(len(list_filter(r.held, lambda x: x.key <> e.key AND x.until > e.ts_ms)) - 1, 1), 3), {{'key': e.key, 'until': e.ts_ms + {DAY}}})
  ELSE list_concat(list_filter(r.held, lambda x: x.key <> e.key), list_filter(r.held, lambda x: x.key = e.key AND x.until > e.ts_ms)) END
FROM r JOIN e ON e.namespace = r.namespace AND e.k = r.k + 1)
SELECT namespace, seq, key, hit FROM r WHERE NOT is_set""")
def lru_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.select((F.col("user_id") % 8).cast("string").alias("namespace"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.when(F.col("event_id") % 3 == 0, "set").otherwise("get").alias("op"), F.col("event_type").alias("key"), F.lit(DAY).alias("ttl_ms"), F.lit(64).alias("size"))
    return state.cache_hits(log, capacity=3)


@query(sql(*RECORDS) + "SELECT arrival_seq, md5('tg:' || lower(trim(title)) || ':a,b') AS few, md5('plugin:' || lower(trim(title)) || ':' || md5('a,b,c,d,e')) AS many FROM records")
def cache_key_md5(spark, sf_dir):
    key = lambda kind, names: request_key(kind, F.col("title"), names).alias("few" if len(names) < 5 else "many")
    return records(spark, sf_dir).select("arrival_seq", key("tg", ["b", "a"]), key("plugin", ["e", "d", "c", "b", "a"]))


def request_key(kind: str, keyword, names: list[str]):
    """The fingerprint of a request: what is asked of which sources, in any order; the list is hashed from five names on."""
    listed = ",".join(sorted(n for n in names if n.strip()))
    part = F.lit("all") if not listed else F.lit(listed) if len(names) < 5 else F.md5(F.lit(listed).cast("binary"))
    return F.md5(F.concat(F.lit(kind + ":"), F.lower(F.trim(keyword)), F.lit(":"), part).cast("binary"))


@query(sql(*RECORDS) + f"""SELECT arrival_seq, CASE WHEN event_ts IS NULL THEN '' WHEN d <= 0 THEN '今天' WHEN d = 1 THEN '昨天' WHEN d < 7 THEN d || '天前' WHEN d < 365 THEN (d // 30) || '个月前' ELSE strftime(event_ts, '%Y-%m-%d') END AS age
FROM (SELECT *, date_diff('day', event_ts, TIMESTAMP '{AS_OF}') AS d FROM records)""")
def age_label(spark, sf_dir):
    return records(spark, sf_dir).select("arrival_seq", text.age_label(F.col("event_ts"), AS_OF).alias("age"))


@query("""WITH m AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM m)
SELECT 'tg-c' || conv_id || '-' || turn AS unique_id, 'https://pan.quark.cn/s/' || substr(md5(text), 1, 8) AS url, substr(md5(text), 9, 4) AS password FROM k WHERE k <= 3""")
def channel_pages(spark, sf_dir):
    h = F.md5(F.col("text").cast("binary"))
    message = F.concat(F.lit('<div class="tgme_widget_message_wrap"><div data-post="c/'), F.col("turn").cast("string"), F.lit('"><div class="tgme_widget_message_text">A https://t.me/share/url?url=https://pan.quark.cn/s/'), F.substring(h, 1, 8), F.lit(" 提取码："), F.substring(h, 9, 4), F.lit('</div></div><time datetime="2024-01-01"></time></div>'))
    pages = table(spark, sf_dir, "conversations").where("text is not null").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("channel"), F.col("turn").alias("page"), message.alias("html"))
    return channels.from_channel_pages(pages, 3).select("unique_id", F.explode("links").alias("l")).select("unique_id", "l.url", "l.password")


@query("SELECT p_brand AS category, p_partkey AS pos, p_partkey AS id, '【' || p_size || '】P' || p_partkey AS title, 'a/b · c' AS text FROM part")
def chart_json(spark, sf_dir):
    n = F.col("p_partkey").cast("string")
    payload = F.concat(F.lit('[{"id":"'), n, F.lit('","title":"P'), n, F.lit('","rating":["'), F.col("p_size").cast("string"), F.lit('"],"types":["a","b"],"regions":["c"]}]'))
    return channels.from_chart_json(table(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("start"), payload.alias("payload"))).select("category", "pos", "id", "title", "text")


@query(sql(*RANKED) + LINKS + f"SELECT url_key, CASE link_type WHEN 'quark' THEN '夸克网盘' WHEN 'baidu' THEN '百度网盘' WHEN '115' THEN '115网盘' ELSE '阿里云盘' END AS platform FROM latest")
def platform_names(spark, sf_dir):
    return merge.named(_latest(spark, sf_dir), catalogue.platforms(spark)).select("url_key", "platform")


@query("SELECT doc_id, doc_id % 13 <> 12 AS supported FROM documents")
def supported_links(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", urls.is_supported(F.expr(HOSTED)).alias("supported"))


@query(f"SELECT doc_id, {HOSTED} || doc_id AS url, {KINDS}[doc_id % 13 + 1] AS link_type FROM documents WHERE doc_id % 13 < 11")
def checkable_links(spark, sf_dir):
    own = F.element_at(F.expr("array" + KINDS.replace("[", "(").replace("]", ")")), (F.col("doc_id") % 13 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.expr(HOSTED), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("doc_id") % 3 == 0, own).otherwise("").alias("link_type"), F.col("doc_id").alias("at"))
    again = d.unionByName(d.where("doc_id % 2 = 0 and doc_id % 13 < 11").withColumns({"at": F.col("at") + 10**9, "link_type": F.lit("quark")}))
    return filters.checkable(again).select(F.col("at").alias("doc_id"), "url", "link_type")


@query("SELECT doc_id, CASE WHEN doc_id % 13 < 11 THEN '1a' WHEN doc_id % 13 = 11 THEN '' ELSE '1a' END AS share FROM documents")
def share_ids(spark, sf_dir):
    u = F.expr(HOSTED)
    return table(spark, sf_dir, "documents").select("doc_id", urls.share_id(u, urls.link_type(u)).alias("share"))


@query("""SELECT o_orderkey AS arrival_seq, o_orderstatus || o_orderpriority AS name FROM orders
QUALIFY row_number() OVER (PARTITION BY CASE WHEN o_orderkey % 4 = 0 THEN 'i' || o_custkey % 50 ELSE o_orderstatus || o_orderpriority END ORDER BY o_orderkey) = 1""")
def composite_key_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arrival_seq"), F.when(F.col("o_orderkey") % 4 == 0, (F.col("o_custkey") % 50).cast("string")).alias("disk_id"), F.lit("").alias("link"), F.concat("o_orderstatus", "o_orderpriority").alias("name"), F.lit("").alias("kind"))
    return merge.first_of_each(rows).select("arrival_seq", "name")


@query("SELECT user_id AS request, event_id FROM events WHERE (user_id, event_id // 100) IN (SELECT (user_id, max(event_id // 100)) FROM events GROUP BY user_id)")
def latest_run(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("request"), F.floor(F.col("event_id") / 100).alias("run_id"), "event_id")
    return merge.of_latest_run(e).select("request", "event_id")


@query("SELECT n_name AS name, row_number() OVER (ORDER BY n_name NOT IN ('FRANCE', 'CHINA', 'NATION_3', 'NATION_7'), n_nationkey) AS arrival FROM nation")
def channels_priority_first(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ordinal"))
    return rank.priority_first(n, ["FRANCE", "CHINA", "NATION_3", "NATION_7"]).select("name", "arrival")


@query("SELECT doc_id, ['baidu', 'quark', 'tianyi', 'others'][doc_id % 4 + 1] AS kind, ['ab12', '', 'zz', 'f'][doc_id % 4 + 1] AS code FROM documents")
def mapped_types_and_codes(spark, sf_dir):
    at = (F.col("doc_id") % 4).cast("int") + 1
    name = F.element_at(F.array(*[F.lit(x) for x in ("BDY", "quark", "ty ", "?")]), at)
    url = F.element_at(F.array(*[F.lit(x) for x in ("https://pan.baidu.com/s/1?pwd=ab12", "https://pan.quark.cn/s/1", "https://cloud.189.cn/t/1（访问码：zz）", "https://example.org/")]), at)
    return table(spark, sf_dir, "documents").select("doc_id", urls.mapped_type(name, url).alias("kind"), urls.share_password(url, F.when(at == 4, "f")).alias("code"))


QUARK = "'https://pan.quark.cn/s/' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)"


def _quark(of="doc_id"):
    return F.concat(F.lit("https://pan.quark.cn/s/"), F.substring(F.md5(F.col(of).cast("string").cast("binary")), 1, 8))


def _payload(source: str, *parts):
    return F.lit(source).alias("source"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("payload")


def _captured(spark, sf_dir, source: str, *parts):
    return table(spark, sf_dir, "documents").select("doc_id", *_payload(source, *parts))


def _found(records):
    return records.select("unique_id", "title", F.posexplode("links").alias("pos", "l")).select("unique_id", "title", "pos", F.col("l.type").alias("link_type"), "l.url", "l.password")


CUSTOM = {s.name: s for s in custom.CUSTOM}


@query(f"""WITH s AS (SELECT * FROM (VALUES ('wanou', true), ('ouge', false)) v(name, strict)),
l AS (SELECT doc_id, name, strict, unnest([0, 1, 2]) AS pos, {QUARK} AS q FROM documents, s)
SELECT name || '-' || doc_id AS unique_id, 'T' || doc_id AS title, CAST(CASE WHEN strict AND pos = 2 THEN 1 ELSE pos END AS INTEGER) AS pos, ['quark', 'baidu', 'uc'][CASE WHEN strict THEN CASE pos WHEN 0 THEN 1 ELSE 2 END WHEN pos = 2 THEN 2 WHEN pos = 1 THEN 3 ELSE 1 END] AS link_type,
  CASE pos WHEN 2 THEN 'https://pan.baidu.com/s/1' || doc_id || '?pwd=ab12' WHEN 1 THEN q || 'x' ELSE q END AS url, CASE pos WHEN 2 THEN 'ab12' ELSE '' END AS password FROM l WHERE NOT strict OR pos <> 1""")
def custom_zip_sources(spark, sf_dir):
    """Two delimited lists: a name that disagrees with its link's host goes, or stays, as the source has it; what has no partner goes."""
    n, q = F.col("doc_id").cast("string"), _quark()
    parts = ('{"code":1,"list":[{"vod_id":', n, ',"vod_name":" T', n, ' ","vod_down_from":"KG$$$UC$$$BD$$$XL","vod_down_url":"', q, "$$$", q, 'x$$$https://pan.baidu.com/s/1', n, '?pwd=ab12"}]}')
    return _found(custom.records_of(CUSTOM["wanou"], _captured(spark, sf_dir, "wanou", *parts))).unionByName(_found(custom.records_of(CUSTOM["ouge"], _captured(spark, sf_dir, "Ouge", *parts))))


@query(f"""SELECT 'yunso-f' || doc_id AS unique_id, 'T' || doc_id AS title, 0 AS pos, 'quark' AS link_type, {QUARK} || '?pwd=cd34' AS url, 'cd34' AS password FROM documents
UNION ALL SELECT 'xdyh-' || doc_id, 'T' || doc_id, 0, 'quark', {QUARK}, '' FROM documents""")
def custom_link_sources(spark, sf_dir):
    """A link in a field (of unknown hosts: left out), and links anywhere in an item."""
    n, q = F.col("doc_id").cast("string"), _quark()
    one = _captured(spark, sf_dir, "yunso", '{"data":{"list":[{"full_id":"f', n, '","title":"T', n, '","url":"', q, '?pwd=cd34"},{"title":"x","url":"https://example.org/"}]}}')
    text = _captured(spark, sf_dir, "xdyh", '{"results":[{"id":"', n, '","name":"T', n, '","more":{"a":["see ', q, ' or https://example.org/"]}}]}')
    return _found(custom.records_of(CUSTOM["yunso"], one)).unionByName(_found(custom.records_of(CUSTOM["xdyh"], text)))


@query(f"""SELECT 'hunhepan-' || g AS unique_id, 'T' || g AS title, 0 AS pos, 'quark' AS link_type, 'https://pan.quark.cn/s/' || substr(md5(CAST(g AS VARCHAR)), 1, 8) AS url, 'p' AS password FROM (SELECT DISTINCT doc_id // 10 AS g FROM documents)""")
def custom_pooled_source(spark, sf_dir):
    """The same resource from several pools counts once; types without a name go."""
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("g"), "doc_id")
    n = F.col("g").cast("string")
    item = F.concat(F.lit('{"disk_id":"'), n, F.lit('","disk_name":"<em>T'), n, F.lit('</em>","disk_type":"QUARK","disk_pass":"p","link":"'), _quark("g"), F.lit('"}'))
    odd = F.concat(F.lit('{"disk_id":"o'), n, F.lit('","disk_name":"x","disk_type":"ODD","link":"https://pan.quark.cn/s/o"}'))
    items = F.concat(F.lit('{"code":200,"data":{"list":['), item, F.lit(","), odd, F.lit("]}}"))
    return _found(custom.records_of(CUSTOM["hunhepan"], d.select(F.lit("hunhepan").alias("source"), items.alias("payload"))))


@query(f"SELECT 'pan666-' || doc_id AS unique_id, 'T' || doc_id AS title, 0 AS pos, 'quark' AS link_type, {QUARK} AS url, '' AS password FROM documents WHERE doc_id % 3 <> 0")
def custom_posts_source(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    parts = ('{"data":[{"id":"', n, '","attributes":{"title":"T', n, '"},"relationships":{"mostRelevantPost":{"data":{"id":"', (F.col("doc_id") % 3).cast("string"), '"}}}}],"included":[{"id":"1","attributes":{"contentHtml":"<a href=', _quark(), '>"}},{"id":"2","attributes":{"contentHtml":"<p>', _quark(), '</p>"}},{"id":"9"}]}')
    return _found(custom.records_of(CUSTOM["pan666"], _captured(spark, sf_dir, "pan666", *parts)))


@query("""SELECT 'thepiratebay-' || doc_id AS unique_id, 'T ' || doc_id AS title, 0 AS pos, 'magnet' AS link_type, 'magnet:?xt=urn:btih:' || md5(CAST(doc_id AS VARCHAR)) || '&dn=x' AS url, '' AS password FROM documents
UNION ALL SELECT 'pioz-0', 'C' || doc_id, 0, 'quark', 'https://pan.quark.cn/s/' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8), '' FROM documents""")
def custom_page_sources(spark, sf_dir):
    """Rows of a table of torrents, and cards; those without a link go."""
    n, h = F.col("doc_id").cast("string"), F.md5(F.col("doc_id").cast("string").cast("binary"))
    rows = _captured(spark, sf_dir, "thepiratebay", '<table id="searchResult"><tr class="header"><th>x</th></tr><tr><td>a</td><td><div class="detName"><a href="/torrent/', n, '/T" class="detLink">T.', n, '</a></div><a href="magnet:?xt=urn:btih:', h, '&amp;dn=x">m</a></td><td>3</td><td>4</td></tr><tr><td>none</td></tr></table>')
    cards = _captured(spark, sf_dir, "pioz", '<div class="resource-card"><h3>C', n, '</h3><p>about</p><a href="', _quark(), '">get</a></div><div class="resource-card"><h3>none</h3></div>')
    return _found(custom.records_of(CUSTOM["thepiratebay"], rows)).unionByName(_found(custom.records_of(CUSTOM["pioz"], cards)))


@query(f"SELECT 'duoduo-' || doc_id AS unique_id, 'T' || doc_id AS title, 0 AS pos, 'quark' AS link_type, {QUARK} AS url, '' AS password FROM documents WHERE doc_id % 2 = 0")
def custom_detail_sources(spark, sf_dir):
    """Cards of result pages joined with the detail pages that were captured."""
    n = F.col("doc_id").cast("string")
    d = table(spark, sf_dir, "documents")
    cards = _captured(spark, sf_dir, "duoduo", '<div class="module-search-item"><h3><a href="/vod/detail/', n, '">T', n, "</a></h3></div>")
    pages = d.where("doc_id % 2 = 0").select(F.lit("duoduo").alias("source"), F.concat(F.lit("https://d.example/vod/detail/"), n).alias("url"), F.concat(F.lit('<body>https://pan.quark.cn/s/head<div id="download-list"><a data-clipboard-text="'), _quark(), F.lit('">x</a></div></body>')).alias("html"))
    return _found(custom.records_of(CUSTOM["duoduo"], cards, pages))


@query(f"""WITH s AS (SELECT doc_id, ['wanou', 'yunso', 'xdyh', 'pioz'][doc_id % 4 + 1] AS name FROM documents), bad AS (SELECT 'yunso' AS name)
SELECT CASE name WHEN 'pioz' THEN 'pioz-0' ELSE name || '-' || doc_id END AS unique_id, {QUARK} AS url FROM s WHERE name NOT IN (SELECT name FROM bad)
UNION ALL SELECT 'warning', 'unhealthy yunso'""")
def federated_scan(spark, sf_dir):
    """All chosen healthy sources; an unhealthy one gives a warning."""
    n, q = F.col("doc_id").cast("string"), _quark()
    j = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    shapes = (j('{"list":[{"vod_id":', n, ',"vod_name":"T","vod_down_from":"KG","vod_down_url":"', q, '"}]}'), j('{"list":[{"qid":"', n, '","url":"', q, '"}]}'), j('{"list":[{"id":"', n, '","a":"', q, '"}]}'), j('<div class="card"><h3>T</h3>', q, "</div>"))
    at = (F.col("doc_id") % 4).cast("int") + 1
    payloads = table(spark, sf_dir, "documents").select(F.element_at(F.array(*[F.lit(x) for x in ("wanou", "yunso", "xdyh", "pioz")]), at).alias("source"), F.element_at(F.array(*shapes), at).alias("payload"))
    health = spark.createDataFrame([("YUNSO", False), ("wanou", True)], "name string, healthy boolean")
    found, warned = custom.federated(payloads, health, chosen=("wanou", "yunso", "xdyh", "pioz"))
    return found.select("unique_id", F.explode("links.url").alias("url")).unionByName(warned.select(F.lit("warning").alias("unique_id"), F.concat_ws(" ", "message", "source").alias("url")))
