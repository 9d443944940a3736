"""Captures: one scan over all sources, and channel pages as a stream."""

import os


from tessel import crawl_queries
from tessel.sources import captured, catalogue, federation, registry

SF = "/root/testdata/sf0.001"


def made(spark, rows):
    return captured.capture(spark.createDataFrame(rows, "source string, url string, payload string"), "test")


def test_layouts_are_all_sources():
    catalogue.register_all()
    assert set(federation.LAYOUTS) == {s.name for s in registry.registered()} and len(federation.LAYOUTS) == 68


def test_only_folders_of_chosen_sources_are_read(spark):
    path = made(spark, [(s, "u", "{}") for s in ("wanou", "ouge", "a b", "pioz")])
    reader = captured.PushedReader(path, {})
    sources = lambda: {source for p in reader.partitions() for source, _, _ in p.parts}
    assert sources() == {"wanou", "ouge", "a b", "pioz"}
    from pyspark.sql.datasource import EqualTo, In, IsNotNull

    other = IsNotNull(("source",))
    assert list(reader.pushFilters([In(("source",), ("wanou", "a b", "x")), other, EqualTo(("url",), "u")])) == [other, EqualTo(("url",), "u")]
    assert sources() == {"wanou", "a b"}
    assert list(reader.pushFilters([EqualTo(("source",), "wanou")])) == [] and sources() == {"wanou"}
    got = captured.captured(spark, path)
    assert {r["source"] for r in got.where("source = 'ouge'").collect()} == {"ouge"} and got.count() == 3  # a page without an item gives no row
    assert {r["source"] for r in captured.captured(spark, path, ("ouge", "a b", "none")).collect()} == {"ouge", "a b"}
    assert {r["source"] for r in captured.captured(spark, path, pushed=True).where("source in ('ouge', 'a b')").collect()} == {"ouge", "a b"}


def test_files_that_cannot_be_read_are_rows(spark):
    path = made(spark, [("wanou", "u", '{"list":[{"vod_id":1,"vod_name":"T","vod_down_from":"KG","vod_down_url":"https://pan.quark.cn/s/1"}]}'), ("ouge", "u", None), ("yunso", "u", "{")])
    os.makedirs(f"{path}/source=bixin")
    with open(f"{path}/source=bixin/part.parquet", "wb") as f:
        f.write(b"no parquet")
    health = spark.createDataFrame([("xys", False)], "name string, healthy boolean")
    found, warned = federation.federated(captured.captured(spark, path), health)
    assert [(r["unique_id"], r["links"][0]["url"]) for r in found.collect()] == [("wanou-1", "https://pan.quark.cn/s/1")]
    said = {r["source"]: r["message"] for r in warned.collect()}
    assert said["xys"] == "unhealthy" and said["yunso"] == "unreadable" and said["ouge"] == "no payload" and said["bixin"].startswith("ArrowInvalid") and len(said) == 4


def test_one_scan_for_all_sources(spark, capsys):
    path = made(spark, [("wanou", "u", "{}")])
    found, _ = federation.federated(captured.captured(spark, path), spark.createDataFrame([], "name string, healthy boolean"))
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("BatchScan") == 1 and "Union" not in plan


def test_chosen_sources_and_health(spark):
    shapes, fill = crawl_queries.SHAPES, lambda t: t.replace("{n}", "7").replace("{q}", "https://pan.quark.cn/s/7").replace("{h}", "ab").replace("{s}", "x")
    path = made(spark, [(s, "u", fill(shapes[s][0])) for s in federation.LAYOUTS])
    details = made(spark, [(f"{s} detail", fill(shapes[s][1][0]), fill(shapes[s][1][1])) for s in federation.LAYOUTS if shapes[s][1]])
    health = spark.createDataFrame([("susu", False), ("Wanou", True)], "name string, healthy boolean")
    found, _ = federation.federated(captured.captured(spark, path), health, captured.captured(spark, details), chosen=("WANOU", "susu", "pioz", "clxiong"))
    assert sorted(r["unique_id"] for r in found.collect()) == ["clxiong-7-0", "clxiong-7-1", "pioz-0", "wanou-7"]
    found, _ = federation.federated(captured.captured(spark, path), health, captured.captured(spark, details))
    assert {r["source"] for r in found.collect()} == set(federation.LAYOUTS) - {"susu"}


def page(n, before):
    link = f'<a href="/s/c?q=x&amp;before={before}">more</a>' if before else ""
    return f'<div class="tgme_widget_message_wrap"><div class="tgme_widget_message" data-post="c/{n}"><div class="tgme_widget_message_text">M{n} https://pan.quark.cn/s/{n}</div></div></div>{link}'


def test_pages_of_channels_go_on_where_they_stopped(spark, tmp_path):
    pages = {"latest": page(5, "40"), "40": page(4, "30"), "30": page(3, "20"), "20": page(2, "10"), "10": page(1, "")}
    for channel in ("a", "b"):
        os.makedirs(tmp_path / "pages" / channel)
    def add(channel, cursor):
        (tmp_path / "pages" / channel / f"{cursor}.html").write_text(pages[cursor])

    def run():
        stream = captured.channel_stream(spark, str(tmp_path / "pages"))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r["channel"], r["cursor"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    add("a", "latest"), add("a", "40"), add("b", "latest")
    assert run() == [("a", "40"), ("a", "latest"), ("b", "latest")]
    for cursor in ("30", "20", "10"):
        add("a", cursor)
    add("b", "40")
    assert run() == [("a", c) for c in ("10", "20", "30", "40", "latest")] + [("b", "40"), ("b", "latest")]
    assert run() == [("a", c) for c in ("10", "20", "30", "40", "latest")] + [("b", "40"), ("b", "latest")]
    reader = captured.ChannelStream(str(tmp_path / "pages"))
    rows, after = reader.read({"a": "30", "b": "40"})
    assert [r[:2] for r in rows] == [("a", "30"), ("b", "40")] and after == {"a": "20", "b": "30"}
    assert [r[:2] for r in reader.readBetweenOffsets({"a": "30", "b": "30"}, {"a": "20", "b": "30"})] == [("a", "30")]
