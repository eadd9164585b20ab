"""Registry of the engine's queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.driver_views import with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query, with its SQL twin over the driver's tables and these views."""

    def register(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is there already")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = with_views(sql, *views)
        return f

    return register


def _load() -> None:
    from .plans import audits, crawl, history, lines, modules, pages, probes, punch, reports, robots, rollups, scoring, search, signals, stores, tables, texts, urls  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
