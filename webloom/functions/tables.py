"""Table functions over pages for SQL: links, language alternates, questions and answers, JSON-LD nodes.

``register(spark)``, then ``SELECT ... FROM pages, LATERAL page_links(html, url)``.  The
last argument, a constant list of column names, chooses and orders the columns, so a
function's schema follows from its call.  A page that can't be parsed gives what was
read of it, a null page nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any
from urllib.parse import urljoin

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.crawlpage import CrawlPage
from ..operators.facts import facts_of
from ..operators.jsonld import page_nodes


def _text(*names: str) -> dict[str, Any]:
    return {n: StringType() for n in names}


LINKS, ALTERNATES = {"place": IntegerType()} | _text("target", "anchor", "rel"), {"place": IntegerType()} | _text("language", "target")
QUESTIONS, NODES = {"place": IntegerType()} | _text("question", "answer"), {"place": IntegerType()} | _text("type", "missing", "json")


def _analyzed(columns: dict[str, Any], chosen: AnalyzeArgument | None) -> AnalyzeResult:
    if chosen is not None and not chosen.isConstantExpression:
        raise ValueError("the list of columns must be a constant")
    names = [n.strip() for n in chosen.value.split(",")] if chosen is not None and chosen.value else list(columns)
    if unknown := [n for n in names if n not in columns]:
        raise ValueError(f"no column {', '.join(unknown)}; there are {', '.join(columns)}")
    return AnalyzeResult(StructType([StructField(n, columns[n]) for n in names]))


def _rows(columns: dict[str, Any], chosen: str | None, rows: list[tuple]) -> Iterator[tuple]:
    names = [n.strip() for n in chosen.split(",")] if chosen else list(columns)
    places = [list(columns).index(n) - 1 for n in names]
    for k, row in enumerate(rows):
        yield tuple(k + 1 if p < 0 else row[p] for p in places)


class _Crawl(CrawlPage):
    """A crawl's parse that keeps the language alternates too."""

    def __init__(self, base: str):
        super().__init__(base)
        self.alternates: list[tuple[str, str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, attrs)
        a = {k.lower(): v or "" for k, v in attrs}
        if tag == "link" and "alternate" in a.get("rel", "").lower() and a.get("hreflang"):
            self.alternates.append((a["hreflang"], urljoin(self.base, a.get("href", ""))))


def _crawled(html: str | None, url: str | None) -> _Crawl:
    parser = _Crawl(url or "")
    try:
        parser.feed(html or "")
        parser.close()
    except (ValueError, AssertionError):  # what was read so far stands
        pass
    return parser


@udtf
class PageLinks:
    @staticmethod
    def analyze(html: AnalyzeArgument, url: AnalyzeArgument, columns: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(LINKS, columns)

    def eval(self, html: str, url: str, columns: str | None = None) -> Iterator[tuple]:
        yield from _rows(LINKS, columns, [(x["target"], x["anchor"], x["rel"]) for x in _crawled(html, url).found["links"]])


@udtf
class PageAlternates:
    @staticmethod
    def analyze(html: AnalyzeArgument, url: AnalyzeArgument, columns: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(ALTERNATES, columns)

    def eval(self, html: str, url: str, columns: str | None = None) -> Iterator[tuple]:
        yield from _rows(ALTERNATES, columns, _crawled(html, url).alternates)


@udtf
class PageQuestions:
    @staticmethod
    def analyze(html: AnalyzeArgument, columns: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(QUESTIONS, columns)

    def eval(self, html: str, columns: str | None = None) -> Iterator[tuple]:
        yield from _rows(QUESTIONS, columns, [(d["question"], d["answer"]) for d in facts_of(html)["details"]])


@udtf
class PageNodes:
    @staticmethod
    def analyze(html: AnalyzeArgument, columns: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(NODES, columns)

    def eval(self, html: str, columns: str | None = None) -> Iterator[tuple]:
        yield from _rows(NODES, columns, [(n["type"], " ".join(n["missing"]), n["json"]) for n in page_nodes(html)["nodes"]])


FUNCTIONS = {"page_links": PageLinks, "page_alternates": PageAlternates, "page_questions": PageQuestions, "page_json_ld": PageNodes}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
