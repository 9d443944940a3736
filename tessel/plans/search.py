"""The search: a request becomes a plan over records, sources and dead links."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, merge, rank


@dataclass(frozen=True)
class Request:
    """What is asked. ``shape``: merged (also merge, merged_by_type or empty) or results, anything else is all; include and exclude filter titles; kinds are link types; sources are names, none are all."""

    keyword: str
    shape: str = "merged"
    sources: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    page: int = 1
    limit: int = 100

    def __post_init__(self):
        if not self.keyword.strip() or len(self.keyword) > 200:
            raise ValueError("a keyword of 1 to 200 characters is needed")
        shape = {"": "merged", "merge": "merged", "merged_by_type": "merged"}.get(self.shape, self.shape)
        object.__setattr__(self, "shape", shape if shape in ("merged", "results") else "all")
        if self.page < 1 or not 1 <= self.limit <= 100:
            raise ValueError("page must be 1 at least, and limit from 1 to 100")


@dataclass
class Response:
    """Lazy frames of what was asked for; counts run only when wanted."""

    results: DataFrame | None = None
    links: DataFrame | None = None
    totals: DataFrame | None = field(default=None)


def merged_links(records: DataFrame, sources: DataFrame, request: Request, as_of: str, dead: DataFrame | None = None) -> DataFrame:
    """One row for each resource: its type, newest link and order key ``at``."""
    scored = rank.scored(filters.of_sources(records, list(request.sources)), sources, as_of)
    noted = merge.with_notes(merge.exploded_links(merge.with_titles(scored).drop("content")), request.keyword)
    links = merge.latest_links(noted.withColumn("title", F.col("note")), merge.keyword_match(request.keyword))
    if dead is not None:
        links = merge.without_dead(links, dead)
    links = filters.of_types(links, list(request.kinds))
    return filters.filter_links(links, list(request.include), list(request.exclude))


def results(records: DataFrame, sources: DataFrame, request: Request, as_of: str, dead: DataFrame | None = None) -> DataFrame:
    """Ranked records worth showing, without dead links."""
    scored = rank.scored(filters.of_sources(records, list(request.sources)), sources, as_of).where(rank.quality_gate())
    if dead is not None:
        scored = merge.records_without_dead(scored, dead)
    if request.include or request.exclude:
        scored = filters.filter_nested(scored, list(request.include), list(request.exclude))
    day = F.floor(F.col("ts_ms") / 86_400_000)
    return rank.positions(scored, [-F.col("total"), -day], [F.desc("ts_ms"), F.col("arrival_seq")])


def search(records: DataFrame, sources: DataFrame, request: Request, as_of: str, dead: DataFrame | None = None) -> Response:
    out = Response()
    if request.shape != "results":
        out.links = merged_links(records, sources, request, as_of, dead)
        out.totals = out.links.rollup("link_type").agg(F.count(F.lit(1)).alias("n"))
    if request.shape != "merged":
        out.results = results(records, sources, request, as_of, dead)
    return out
