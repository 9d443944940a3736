"""Search as a polymorphic table function: what it returns and how its rows are dealt follow from its options.

    SELECT * FROM search_records(TABLE(records), 'two words', '{"links": true, "limit": 5}')
    SELECT * FROM terms, LATERAL search_variants(terms.term)
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

LINK = ("type", "url", "password")
#: What the options can be, with their types.
OPTIONS = {"links": bool, "content": bool, "position": bool, "limit": int, "skip": bool, "title_en": str, "by": str, "order": str}


@dataclass
class SearchPlan(AnalyzeResult):
    """What ``analyze`` found out, for the instances that handle rows."""

    options: dict = field(default_factory=dict)
    words: list = field(default_factory=list)
    english: list = field(default_factory=list)


def _options(text: str | None) -> dict:
    try:
        options = json.loads(text or "{}")
    except ValueError as e:
        raise ValueError(f"options are no JSON: {e}") from None
    if not isinstance(options, dict):
        raise ValueError("options must be a JSON object")
    for name, value in options.items():
        if name not in OPTIONS:
            raise ValueError(f"no option {name}; there are {', '.join(OPTIONS)}")
        if type(value) is not OPTIONS[name] or (name == "limit" and value < 1):
            raise ValueError(f"option {name} can't be {value!r}")
    return options


class SearchRecords:
    """Rows of a table of records that hold all words of the keyword in title or content, by case-insensitive search.

    Options: ``links`` gives a row for each link with its type, address and code, ``content`` the content, ``position``
    the place within the source; ``limit`` takes the first of each source (``by``: of another column) in the order of
    ``unique_id`` (``order``: of another column), and has the rows dealt by it; without it, rows are searched where they
    are. ``skip`` leaves the keyword out; ``title_en`` is searched too, a record with all words of either is found. Null
    titles and contents are empty, records without links give no row where links are asked for.
    """

    @staticmethod
    def analyze(records: AnalyzeArgument, keyword: AnalyzeArgument, options: AnalyzeArgument | None = None) -> SearchPlan:
        if not records.isTable:
            raise ValueError("the first argument must be TABLE(...)")
        if not keyword.isConstantExpression or (options is not None and not options.isConstantExpression):
            raise ValueError("keyword and options must be constants")
        chosen = _options(options.value if options is not None else None)
        columns = {f.name: f for f in records.dataType.fields}
        by, order = chosen.get("by", "source"), chosen.get("order", "unique_id")
        needed = ["unique_id", "title", "content"] + (["links"] if chosen.get("links") else []) + ([by, order] if "limit" in chosen or chosen.get("position") else [])
        if missing := [c for c in needed if c not in columns]:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        schema = StructType([StructField("unique_id", columns["unique_id"].dataType), StructField("title", StringType())])
        if chosen.get("content"):
            schema = schema.add("content", StringType())
        if chosen.get("position"):
            schema = schema.add("position", IntegerType())
        if chosen.get("links"):
            for name in LINK:
                schema = schema.add(f"link_{name}", StringType())
        dealt = "limit" in chosen or chosen.get("position")
        words = lambda text: (text or "").lower().split()
        return SearchPlan(
            schema, partitionBy=[PartitioningColumn(by)] if dealt else [], orderBy=[OrderingColumn(order)] if dealt else [],
            options=chosen, words=words(keyword.value), english=words(chosen.get("title_en")),
        )

    def __init__(self, plan: SearchPlan):
        self.options, self.words, self.english, self.place = plan.options, plan.words, plan.english, 0

    def _found(self, row: Row) -> bool:
        if self.options.get("skip"):
            return True
        title, content = (row["title"] or "").lower(), (row["content"] or "").lower()
        has = lambda words: all(w in title or w in content for w in words)
        return has(self.words) or (bool(self.english) and has(self.english))

    def eval(self, row: Row, keyword: str, options: str | None = None) -> Iterator[tuple]:
        if self.place >= self.options.get("limit", self.place + 1) or not self._found(row):
            return
        self.place += 1
        out = [row["unique_id"], row["title"]]
        out += [row["content"]] if self.options.get("content") else []
        out += [self.place] if self.options.get("position") else []
        if self.options.get("links"):
            for link in row["links"] or ():
                yield (*out, *(link[name] for name in LINK))
        else:
            yield tuple(out)


class SearchVariants:
    """The words of a term that it could be searched by, longest first: for LATERAL over a table of terms."""

    @staticmethod
    def analyze(term: AnalyzeArgument, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(term.dataType, StringType):
            raise ValueError("the term must be a string")
        return AnalyzeResult(StructType([StructField("word", StringType()), StructField("place", LongType())]))

    def eval(self, term: str | None, least: int = 1) -> Iterator[tuple]:
        words = sorted({w for w in (term or "").lower().split() if len(w) >= least}, key=lambda w: (-len(w), w))
        yield from ((w, k) for k, w in enumerate(words, 1))


def register(spark: SparkSession) -> None:
    """Makes ``search_records`` and ``search_variants`` SQL table functions of the session."""
    spark.udtf.register("search_records", udtf(SearchRecords))
    spark.udtf.register("search_variants", udtf(SearchVariants))
