"""Registry of named queries (one per operator ID of the inventory) and their
independent SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn
    return deco


def registry_sql(name: str) -> str:
    """The SQL of a query registered before, for use inside another's."""
    return _SQL[name]


def _load_all() -> None:
    from tessera.plans import (q_drift, q_prep, q_aggregates, q_joins, q_rules,  # noqa: F401
                               q_split, q_features, q_text, q_windows, q_metrics,
                               q_runs, q_models, q_sources, q_stream, q_studies)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(sorted(_QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(sorted(_SQL.items()))
