"""Fixed dimensions: the sources with their level and whether the keyword filter is skipped, link types and chart categories."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from .custom import CUSTOM as OWN_LAYOUTS
from .custom import records_of
from .registry import Source, register

CUSTOM = {s.name: s for s in OWN_LAYOUTS}

#: Sources by level; level 3 is the default. Those of SKIPPING bypass the keyword filter.
LEVEL_1 = "susu wanou labi lou1".split()
LEVEL_2 = "alupan dyyjpro kkmao panzun quarktv yunsou discourse nsgame panyq ouge huban clxiong lingjisp melost xys yunso duoduo pioz".split()
LEVEL_3 = (
    "aikanzy ash djgou duanjuw dyyj gaoqing888 gying javdb jutoushe kkv leijing libvio mizixing panlian panwiki pianku quarksoo wuji xdpan xiaoji yiove yuhuage yulinshufa zxzj "
    "bixin haisou jupansou miaoso qqpd quark4k sousou weibo pansearch pan666 jsnoteclub meitizy mikuclub u3c3 xb6v xdyh xiaozhang hunhepan thepiratebay"
).split()
LEVEL_4 = "nyaa 1337x solidtorrents".split()
SKIPPING = "javdb libvio panwiki wuji yiove yuhuage bixin quark4k clxiong thepiratebay".split()
#: Names and colours of link types.
PLATFORMS = (
    ("baidu", "百度网盘", "#2563eb"), ("aliyun", "阿里云盘", "#7c3aed"), ("quark", "夸克网盘", "#6366f1"), ("uc", "UC网盘", "#ef4444"), ("tianyi", "天翼云盘", "#ec4899"),
    ("115", "115网盘", "#f59e0b"), ("xunlei", "迅雷云盘", "#fbbf24"), ("mobile", "移动云盘", "#0ea5e9"), ("pikpak", "PikPak", "#8b5cf6"), ("123", "123网盘", "#10b981"),
    ("guangya", "光鸭云盘", "#14b8a6"), ("magnet", "磁力链接", "#f97316"), ("ed2k", "电驴链接", "#a855f7"), ("others", "其他", "#6b7280"),
)
#: Chart categories: group, type, number.
CHARTS = (
    ("电影", "Top250", -1), ("电影", "剧情", 3), ("电影", "喜剧", 24), ("电影", "动作", 5), ("电影", "爱情", 6), ("电影", "科幻", 15),
    ("电影", "动画", 16), ("电影", "悬疑", 20), ("电影", "犯罪", 10), ("电影", "战争", 22), ("电影", "纪录片", 1), ("电视剧", "热门", 26),
)


def register_all() -> None:
    for level, names in ((1, LEVEL_1), (2, LEVEL_2), (3, LEVEL_3), (4, LEVEL_4)):
        for name in names:
            own = CUSTOM.get(name)
            register(Source(name, level, name in SKIPPING, own and partial(records_of, own)))


def platforms(spark):
    return spark.createDataFrame(PLATFORMS, "link_type string, platform string, colour string")


def chart_categories(spark):
    return spark.createDataFrame(CHARTS, "label string, kind string, type_id int")


def channels(spark, path: str):
    """``name, ordinal, priority`` of the channels that a JSON settings file lists (``defaultChannels``, ``priorityChannels``): each once, in its order; a priority channel that is not listed comes after the others."""
    shape = "defaultChannels array<string>, priorityChannels array<string>"
    c = spark.read.schema(shape).option("multiLine", True).json(path)
    none = F.expr("CAST(array() AS array<string>)")
    listed = F.array_distinct(F.concat(F.coalesce("defaultChannels", none), F.coalesce("priorityChannels", none)))
    first = c.select(F.posexplode(listed).alias("ordinal", "name"), F.coalesce("priorityChannels", none).alias("p"))
    return first.where(F.trim("name") != "").select("name", "ordinal", F.array_contains("p", F.col("name")).alias("priority"))
