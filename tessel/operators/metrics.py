"""Counts and failures of each source, taken while a plan runs instead of by another pass over it."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "source string, rows long, failures long"


def _counts(sources: list[str], failed: Column) -> list[Column]:
    low = F.lower("source")
    out = [F.count(F.lit(1)).alias("rows"), F.count_if(failed).alias("failures")]
    for k, name in enumerate(sources):
        mine = low == name.lower()
        out += [F.count_if(mine).alias(f"rows {k}"), F.count_if(mine & failed).alias(f"failures {k}")]
    return out


class Watched:
    """``rows`` with an observation: once a query over them has ended, ``counts`` has the rows and failures of each source.

    A source's name is compared in lower case; rows of others are in the total, whose name is null. What is counted is what
    passes this point of the plan: a limit behind it may end a query early.
    """

    def __init__(self, rows: DataFrame, sources: list[str], failed: Column):
        self.sources, self.observation = list(sources), Observation()
        self.rows = rows.observe(self.observation, *_counts(self.sources, F.coalesce(failed, F.lit(False))))

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(_listed(self.observation.get, self.sources), METRICS)

    def warnings(self, spark: SparkSession) -> DataFrame:
        """``source, message`` of sources that failed or gave nothing."""
        c = self.counts(spark).where("source is not null and (failures > 0 or rows = 0)")
        return c.select("source", F.when(F.col("rows") == 0, "no answer").otherwise(F.concat(F.col("failures").cast("string"), F.lit(" of "), F.col("rows").cast("string"), F.lit(" failed"))).alias("message"))


def _listed(found: dict, sources: list[str]) -> list[tuple]:
    return [(None, found["rows"], found["failures"])] + [(name, found[f"rows {k}"], found[f"failures {k}"]) for k, name in enumerate(sources)]


def watched_stream(rows: DataFrame, name: str, sources: list[str], failed: Column) -> DataFrame:
    """A stream whose batches tell a ``Listener`` the rows and failures of each source, under ``name``."""
    return rows.observe(name, *_counts(sources, F.coalesce(failed, F.lit(False))))


class Listener(StreamingQueryListener):
    """Adds up what the batches of watched streams tell: rows, failures and milliseconds."""

    def __init__(self, name: str, sources: list[str]):
        self.name, self.sources = name, sources
        self.total: dict = defaultdict(lambda: [0, 0])
        self.batches, self.took_ms = 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is None:
            return
        self.batches += 1
        self.took_ms += event.progress.durationMs.get("triggerExecution", 0)
        for source, rows, failures in _listed(found.asDict(), self.sources):
            self.total[source][0] += rows
            self.total[source][1] += failures

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
