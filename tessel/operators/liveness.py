"""Liveness of links from what a check answered: rows of type, HTTP status and body.

Each type has rules in order, the first that holds counts; bodies are JSON, but for pages of uc and XML of tianyi.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, BAD, LOCKED, UNSUPPORTED, UNCERTAIN = "ok", "bad", "locked", "unsupported", "uncertain"
#: Hours that a state is remembered.
TTL_HOURS = {OK: 24.0, BAD: 6.0, LOCKED: 12.0, UNSUPPORTED: 24.0}
TTL_OTHER_HOURS = 0.5
#: Words and codes of answers.
GONE = ("不存在", "失效", "违规", "过期", "取消")
ASKS_CODE = ("提取码", "密码")
TIANYI_CODES = ("ShareInfoNotFound", "ShareNotFound", "FileNotFound", "ShareExpiredError", "ShareAuditNotPass", "FolderNotFound")
TIANYI_MESSAGES = {"ShareInfoNotFound": "分享信息不存在", "ShareNotFound": "分享链接不存在", "FileNotFound": "分享文件不存在", "ShareExpiredError": "分享链接已过期", "ShareAuditNotPass": "分享因审核未通过已失效", "FolderNotFound": "分享文件夹不存在"}
STATE_LABELS = {OK: "有效", BAD: "失效", LOCKED: "需提取码", UNSUPPORTED: "不支持", UNCERTAIN: "未知"}


def has_any(text: Column, words) -> Column:
    low, hit = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w.lower()))
    return hit


def _rules(*rules: tuple[Column, str]) -> Column:
    out = F.when(F.lit(False), UNCERTAIN)
    for condition, state in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), state)
    return out.otherwise(UNCERTAIN)


def state(kind: Column, status: Column, body: Column) -> Column:
    """ok, bad, locked, unsupported or uncertain. A body that can't be read is uncertain."""
    text = F.coalesce(body, F.lit(""))
    v = lambda path: F.get_json_object(body, path)
    n = lambda path: F.coalesce(v(path).try_cast("long"), F.lit(0))
    some = lambda path: F.coalesce(v(path), F.lit("")) != ""
    true = lambda path: ~F.coalesce(v(path), F.lit("")).isin("", "false", "0")
    listed = lambda path: ~F.coalesce(v(path), F.lit("[]")).isin("", "[]")
    json = F.try_parse_json(body).isNotNull()
    code, share = F.lower(F.trim(F.coalesce(v("$.code"), F.lit("")))), F.lower(F.trim(F.coalesce(v("$.share_status"), F.lit(""))))
    aliyun = _rules(
        (~json, UNCERTAIN),
        (has_any(code, ("sharelink", "notfound", "cancelled", "canceled", "forbidden", "expired")), BAD),
        (code != "", UNCERTAIN),
        ((v("$.file_count") == "0") & ~some("$.share_name"), BAD),
        (has_any(share, ("forbidden", "cancel", "expired", "illegal", "invalid", "disabled")) & ~share.isin("enabled", "normal"), BAD),
        ((status == 200) & (some("$.share_name") | some("$.share_title") | (n("$.file_count") > 0)), OK),
    )
    token, detail = F.coalesce(v("$.token.code").try_cast("int"), F.lit(-1)), F.coalesce(v("$.detail.code").try_cast("int"), F.lit(-1))
    at, partly = n("$.detail.data.share.status"), true("$.detail.data.share.partial_violation")
    quark = _rules(
        (~json, UNCERTAIN),
        (token == 41008, LOCKED),
        (token.isin(41004, 41010, 41011), BAD),
        ((token != 0) & has_any(v("$.token.message"), GONE), BAD),
        ((token != 0) & has_any(v("$.token.message"), ASKS_CODE), LOCKED),
        (token != 0, UNCERTAIN),
        (~F.coalesce(v("$.token.status"), F.lit("")).isin("0", "200"), BAD),
        (~some("$.token.data.stoken"), UNCERTAIN),
        ((detail != 0) & has_any(v("$.detail.message"), (*ASKS_CODE, "passcode")), LOCKED),
        ((detail != 0) & has_any(v("$.detail.message"), GONE), BAD),
        (detail != 0, UNCERTAIN),
        (~listed("$.detail.data.list"), BAD),
        (at == 1, OK),
        ((at == 3) & partly, BAD),
        (at == 3, OK),
        (at > 1, BAD),
        (F.lit(True), OK),
    )
    uc = _rules((status == 404, BAD), (has_any(text, ("失效", "不存在", "违规", "删除", "已过期", "被取消")), BAD), (has_any(text, ("提取码", "访问码", "请输入密码")), LOCKED), (has_any(text, ("文件", "分享", "drive.uc.cn")), OK))
    verified, errno = v("$.verify.errno").try_cast("int"), v("$.list.errno").try_cast("int")
    baidu = _rules(
        (~json, UNCERTAIN),
        (verified.isin(-9, -12), LOCKED),
        (verified != 0, UNCERTAIN),
        ((errno == 0) & listed("$.list.list"), OK),
        (errno == 0, BAD),
        (errno.isin(-9, -12), LOCKED),
        (errno.isin(-7, 105, 115, 117, 145), BAD),
    )
    tag = lambda name: F.regexp_extract(text, f"<{name}>(.*?)</{name}>", 1)
    xml, error = F.contains(text, F.lit("<shareVO>")), F.contains(text, F.lit("<error>"))
    known = F.lit(False)
    for c in TIANYI_CODES:
        known = known | F.contains(text, F.lit(c))
    locked_words = ("accesscode", "访问码", "提取码", "密码")
    tianyi = _rules(
        (xml & ((F.coalesce(tag("shareId").try_cast("long"), F.lit(0)) > 0) | (tag("fileName") != "") | (tag("needAccessCode") == "1")), OK),
        (error & ~has_any(tag("code"), TIANYI_CODES) & has_any(F.when(tag("code") != "", tag("code")).otherwise(tag("message")), locked_words), LOCKED),
        (error, BAD),
        (json & ((n("$.shareId") > 0) | some("$.fileName") | (v("$.needAccessCode") == "1")), OK),
        (json & (some("$.error_code") | known), BAD),
        (json & has_any(v("$.res_message"), locked_words), LOCKED),
        (known, BAD),
        (has_any(text, ("erroraccesscode", "needaccesscode", "访问码", "提取码", "密码")), LOCKED),
        (has_any(text, (*TIANYI_CODES, "不存在", "失效", "取消", "过期")), BAD),
    )
    p123 = _rules((status == 403, OK), (~json, UNCERTAIN), (v("$.code") == "0", OK), (true("$.data.HasPwd"), LOCKED), (F.lit(True), BAD))
    xunlei = _rules(
        (status.isin(403, 404), BAD),
        (~json, UNCERTAIN),
        ((v("$.share_status") == "OK") | some("$.share_id") | some("$.share_name") | (n("$.file_count") > 0), OK),
        (has_any(v("$.error"), ("pass_code",)) | has_any(v("$.error_description"), ("pass_code", *ASKS_CODE)), LOCKED),
        (some("$.share_status"), BAD),
        (has_any(v("$.error_description"), ("参数错误", "share_status", "不存在", "失效", "过期", "not found")), BAD),
    )
    shared = F.when(n("$.data.share_state") != 0, n("$.data.share_state")).otherwise(n("$.data.shareinfo.share_state"))
    fine = true("$.state") & (v("$.errno") == "0")
    p115 = _rules(
        (~json, UNCERTAIN),
        (fine & (listed("$.data.list") | (n("$.data.count") > 0) | some("$.data.shareinfo.snap_id") | some("$.data.shareinfo.share_title") | (shared == 1)), OK),
        (fine & has_any(v("$.data.shareinfo.forbid_reason"), ASKS_CODE), LOCKED),
        (fine, BAD),
        (has_any(v("$.error"), (*ASKS_CODE, "receive_code")), LOCKED),
        (some("$.error"), BAD),
    )
    mobile = _rules((~json, UNCERTAIN), ((v("$.resultCode") == "0") & v("$.data").isNotNull(), OK), (has_any(v("$.desc"), (*ASKS_CODE, "访问码")), LOCKED), (has_any(v("$.desc"), ("失效", "不存在", "过期", "取消")), BAD), (some("$.desc"), UNCERTAIN), (some("$.resultCode"), BAD))
    out = F.when(F.lit(False), UNCERTAIN)
    for name, rules in (("aliyun", aliyun), ("quark", quark), ("uc", uc), ("baidu", baidu), ("tianyi", tianyi), ("123", p123), ("xunlei", xunlei), ("115", p115), ("mobile", mobile)):
        out = out.when(kind == name, rules)
    return out.otherwise(UNSUPPORTED)


def ttl_ms(of_state: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, hours in TTL_HOURS.items():
        out = out.when(of_state == name, int(hours * 3_600_000))
    return out.otherwise(int(TTL_OTHER_HOURS * 3_600_000)).cast("long")


def state_label(of_state: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, label in STATE_LABELS.items():
        out = out.when(of_state == name, label)
    return out.otherwise("")


def tianyi_message(code: Column, fallback: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, label in TIANYI_MESSAGES.items():
        out = out.when(F.trim(code) == name, label)
    return out.otherwise(F.coalesce(F.nullif(F.trim(fallback), F.lit("")), code))


def checked(probes: DataFrame, checked_at: Column) -> DataFrame:
    """Probes (kind, http_status, body) with ``state``, ``checked_at`` and ``expires_at`` in milliseconds."""
    p = probes.withColumn("state", state(F.col("kind"), F.col("http_status"), F.col("body")))
    return p.withColumns({"checked_at": checked_at, "expires_at": checked_at + ttl_ms(F.col("state"))})


def split_cached(links: DataFrame, cache: DataFrame, as_of_ms: Column) -> tuple[DataFrame, DataFrame]:
    """(links with a state that has not expired, links still to check)."""
    alive = cache.where(F.col("expires_at") > as_of_ms).select("url", "state")
    return links.join(alive, "url"), links.join(alive.select("url"), "url", "left_anti")


def pruned(cache: DataFrame, as_of_ms: Column) -> DataFrame:
    """Cached states that have not expired."""
    return cache.where(F.col("expires_at") > as_of_ms)


def cache_key(kind: Column, normalised: Column, scope: str = "") -> Column:
    return F.concat_ws("|", kind, normalised, *([F.lit(scope)] if scope else []))


def known_states(links: DataFrame, cache: DataFrame, as_of_ms: Column) -> DataFrame:
    """Links with their cached ``state``, null where none is fresh."""
    return links.join(pruned(cache, as_of_ms).select("url", "state"), "url", "left")
