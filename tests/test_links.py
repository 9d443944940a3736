"""The automaton of drive links against the rules as columns."""

import random
import time

from pyspark.sql import functions as F

from tessel.functions import links, urls
from tessel.sources import registry

HOSTS = ["pan.baidu.com/s/1aB_-", "cloud.189.cn/t/abc", "drive.uc.cn/s/ab?public=1", "www.123pan.com/s/aB-1", "123684.com/s/x?提取码:ab1", "115.com/s/ab?password=cd12#", "115cdn.com/s/abc", "www.alipan.com/s/abC", "aliyundrive.com/s/x1", "guangyapan.com/s/a-b",
         "yun.139.com/shareweb/#/w/i/2ab", "caiyun.139.com/m/i?1A5", "caiyun.feixin.10086.cn/x1", "pan.quark.cn/s/ab12", "pan.xunlei.com/s/V?pwd=ab1c#", "mypikpak.com/s/p", "a.b-c.pan.quark.cn/list", "PAN.BAIDU.cn/x", "example.org/s/1", "cloud.189.cn/t/a%EF%BC%88%E8%AE%BF%E9%97%AE%E7%A0%81%EF%BC%9Ab2c3%EF%BC%89"]
GLUE = ["", " ", "\n", "，", "提取码：", "密码: ", "pwd=", "ab12", "?pwd=ab12", "&x=1", "（访问码：xy12）", "更多", "网盘", "标签", "https", "。", "#", "链接：", "é", "İ"]
WHOLE = ["magnet:?xt=urn:btih:ABCdef123", "magnet:?xt=urn:btih:ABCdef123&dn=x", "ed2k://|file|a b.mkv|12|ABCDEF0123|/", "ed2k://|file|a|x|y|"]


def texts():
    rng, out = random.Random(11), ["", "nothing here", "pan.quark.cn", "https://", "https://https://pan.quark.cn/s/a https://pan.quark.cn/s/ab"]
    for _ in range(700):
        parts = []
        for _ in range(rng.randint(1, 7)):
            parts.append(rng.choice(GLUE))
            parts.append(rng.choice(WHOLE) if rng.random() < 0.15 else rng.choice(["https://", "http://", "HTTPS://", "", "https://www."]) + rng.choice(HOSTS))
        out.append("".join(parts) + rng.choice(GLUE))
    return out


def test_automaton_equals_the_columns(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts())] + [(-1, None)], "k int, t string").repartition(4)
    native = F.transform(urls.drive_links(F.col("t")), lambda u: F.struct(urls.link_type(u).alias("type"), u.alias("url"), urls.access_code(F.col("t"), u).alias("password")))
    both = df.select("k", "t", F.coalesce(native, F.array()).alias("a"), links.links_in(F.col("t")).alias("b")).collect()
    assert sum(len(r["b"]) for r in both) > 1000
    for r in both:
        assert [tuple(x) for x in r["a"]] == [tuple(x) for x in r["b"]], r["t"]


def test_linear_in_hits():
    for piece in ("alipan.com", "https://alipan.com/s/", "http", "pan.quark.cn/s/ ", "https://x.", "ed2k://|file|", "https://cloud.189.cn/t/a（"):
        began = time.perf_counter()
        links.drive_links(piece * 20_000)
        assert time.perf_counter() - began < 10, piece


def test_links_of_records(spark):
    text = "https://pan.baidu.com/s/1x 提取码：ab12 https://pan.quark.cn/s/q"
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(registry.links_of(F.col("t"))).alias("l")).select("l.*").collect()
    assert [tuple(r) for r in got] == [("baidu", "https://pan.baidu.com/s/1x", "ab12"), ("quark", "https://pan.quark.cn/s/q", "ab12")]
