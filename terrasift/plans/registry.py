"""All registered queries of the spatial engine, with the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrasift.plans.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "agg_grid_mean"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may name the projections of ``fixtures``. Without SQL only its rows are checked."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = with_views(sql)
        return f

    return register


def _load() -> None:
    from terrasift.plans import composites, geometry, joins, point_clouds, rasters, streams, tables, texts  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
