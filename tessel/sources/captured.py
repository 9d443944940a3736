"""Captured payloads as a data source: one scan over all sources, and channel pages as a stream that goes on where it stopped.

A capture is a Parquet table partitioned by ``source`` (folders ``source=name``) with columns ``url`` and ``payload``. Only
the folders of sources that a filter asks for are listed as partitions, a file that can't be read is a row that says so,
and pages are cut into elements where they are read.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, SimpleDataSourceStreamReader

from ..functions.html import _ELEMENT, ELEMENT, Rules, matched

SCHEMA = f"source string, url string, payload string, at int, root {ELEMENT}, inside array<{ELEMENT}>, error string"
#: Rows of a Parquet file that are read at once; bytes of files that a task reads at most (a row group is never cut) and at least; tasks there should be.
BATCH_ROWS, TASK_BYTES, LEAST_TASK_BYTES, LEAST_TASKS = 64, 128 << 20, 1 << 20, 256
BEFORE = re.compile(r"before=([^&\"'#]+)")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Files(InputPartition):
    """(source, path, row group) of the parts that one task reads; a row group of None is a file whose footer can't be read."""

    parts: tuple[tuple[str, str, int | None], ...]


@dataclass
class Given:
    """What is known before reading: the sources whose payloads are pages, with their selectors and the name of the root."""

    rules: dict[str, tuple[dict[str, str], str | None, tuple[str, ...]]]

    @cache  # noqa: B019  (one instance a task)
    def of(self, source: str) -> tuple[Rules, str | None, frozenset] | None:
        if source not in self.rules:
            return None
        selectors, root, spaced = self.rules[source]
        return Rules(selectors), root, frozenset(spaced)

    def __hash__(self) -> int:
        return id(self)


class CapturedReader(DataSourceReader):
    def __init__(self, path: str, rules: dict, wanted: set[str] | None = None):
        self.path, self.rules, self.wanted = path, rules, wanted

    def partitions(self) -> list[InputPartition]:
        files, root = _opened(self.path)
        found: list[tuple[tuple[str, str, int | None], int]] = []
        for info in sorted(files.get_file_info(fs.FileSelector(root, recursive=False)), key=lambda i: i.path):
            name = unquote(info.base_name.removeprefix("source="))
            if info.type != fs.FileType.Directory or not info.base_name.startswith("source=") or (self.wanted is not None and name not in self.wanted):
                continue
            for f in sorted(files.get_file_info(fs.FileSelector(info.path, recursive=False)), key=lambda i: i.path):
                if f.type != fs.FileType.File or f.base_name[0] in "._":
                    continue
                try:
                    footer = pq.read_metadata(f.path, filesystem=files)
                    found += [((name, f.path, k), footer.row_group(k).total_byte_size) for k in range(footer.num_row_groups)]
                except (pa.ArrowInvalid, OSError):
                    found.append(((name, f.path, None), f.size))
        most = min(TASK_BYTES, max(LEAST_TASK_BYTES, sum(n for _, n in found) // LEAST_TASKS))
        out, parts, size = [], [], 0
        for part, n in found:
            if parts and size + n > most:
                out.append(Files(tuple(parts)))
                parts, size = [], 0
            parts.append(part)
            size += n
        return [*out, Files(tuple(parts))] if parts else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(self.path)
        given = Given(self.rules)
        for source, path, group in partition.parts:
            try:
                for batch in pq.ParquetFile(path, filesystem=files).iter_batches(BATCH_ROWS, row_groups=None if group is None else [group], columns=["url", "payload"]):
                    yield _rows(source, batch, given)
            except (pa.ArrowInvalid, OSError, KeyError) as e:
                yield _batch([(source, path, None, None, None, None, f"{type(e).__name__}: {e}"[:200])])


class PushedReader(CapturedReader):
    """Takes filters on ``source`` from the query."""

    def pushFilters(self, filters) -> Iterator:
        """Equality and membership of ``source`` choose folders; Spark checks all else."""
        for f in filters:
            names = None
            if isinstance(f, EqualTo) and f.attribute == ("source",):
                names = {f.value}
            elif isinstance(f, In) and f.attribute == ("source",):
                names = set(f.value)
            if names is None:
                yield f
            else:
                self.wanted = names if self.wanted is None else self.wanted & names


_TYPES = {"source": pa.string(), "url": pa.string(), "payload": pa.string(), "at": pa.int32(), "root": _ELEMENT, "inside": pa.list_(_ELEMENT), "error": pa.string()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES.values())], names=[*_TYPES])


def _rows(source: str, batch: pa.RecordBatch, given: Given) -> pa.RecordBatch:
    """A page gives a row for each root element, any other payload itself."""
    rows, rules = [], given.of(source)
    for url, payload in zip(batch.column("url").to_pylist(), batch.column("payload").to_pylist()):
        if payload is None:
            rows.append((source, url, None, None, None, None, "no payload"))
        elif rules is None:
            rows.append((source, url, payload, None, None, None, None))
        else:
            page = payload.replace("\r\n", "\n").replace("\r", "\n")
            rows += [(source, url, None, k, root, inside, None) for k, (root, inside) in enumerate(matched(page, *rules))]
    return _batch(rows)


class ChannelStream(SimpleDataSourceStreamReader):
    """Captured pages of channels, one page of each channel at a time, from the newest back: the offset is the cursor of each.

    A page is the file ``<before>.html`` in the folder of its channel, the newest is ``latest.html``; its link with
    ``before=`` names the next. A cursor whose page was not captured (yet) waits; a channel ends at a page without a link.
    """

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        files, root = _opened(self.path)
        names = [i.base_name for i in files.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory]
        return {name: "latest" for name in sorted(names)}

    def _page(self, channel: str, cursor: str) -> str | None:
        files, root = _opened(self.path)
        path = f"{root}/{channel}/{cursor}.html"
        if not cursor or files.get_file_info(path).type != fs.FileType.File:
            return None
        with files.open_input_stream(path) as f:
            return f.read().decode("utf-8", "replace")

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, after = [], dict(self.initialOffset() | start)
        for channel, cursor in after.items():
            if (page := self._page(channel, cursor)) is not None:
                rows.append((channel, cursor, page))
                following = BEFORE.search(page)
                after[channel] = following[1] if following and following[1] != cursor else ""
        return iter(rows), after

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The pages from one offset to another again, for a batch that has to be repeated."""
        for channel, cursor in (self.initialOffset() | start).items():
            if end.get(channel, cursor) != cursor and (page := self._page(channel, cursor)) is not None:
                yield channel, cursor, page


class Captured(DataSource):
    """``captured``: a batch source over a capture (option ``path``), and a stream over the pages of channels."""

    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CapturedReader:
        from .federation import page_rules

        chosen = self.options.get("sources", "")
        kind = PushedReader if self.options.get("pushed") == "true" else CapturedReader
        return kind(self.options["path"], page_rules(), set(chosen.split(",")) if chosen else None)

    def simpleStreamReader(self, schema) -> ChannelStream:
        return ChannelStream(self.options["path"])


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; a local session that has none gets one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessel-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root}/{name}-{uuid.uuid4().hex}"


def capture(payloads: DataFrame, name: str) -> str:
    """Writes payloads (source, url, payload) as a capture in the shared folder; gives its path."""
    path = shared_path(payloads.sparkSession, name)
    payloads.select("source", "url", "payload").write.partitionBy("source").parquet(path)
    return path


PAGES = "channel string, cursor string, html string"


def captured(spark: SparkSession, path: str, sources: tuple[str, ...] = (), pushed: bool = False) -> DataFrame:
    """One scan over a capture, of the folders of ``sources`` or all: ``source, url, payload, at, root, inside, error``.

    With ``pushed`` the query's filters on ``source`` choose folders too, and the session pushes filters into Python sources
    from now on. Spark 4.1 keeps for later queries of a DataFrame what its first one pushed: such a one is for one query.
    """
    spark.dataSource.register(Captured)
    if pushed:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("captured").option("sources", ",".join(sources)).option("pushed", str(pushed).lower()).load(path)


def channel_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of captured channel pages: ``channel, cursor, html``."""
    spark.dataSource.register(Captured)
    return spark.readStream.format("captured").schema(PAGES).option("path", path).load()
