"""Registry of named queries: a Spark callable and, where SQL can say the
same thing, the DuckDB oracle text."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str | Callable[[], str]] = {}


def register(name: str, sql: str | Callable[[], str] | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # importing the plan modules fills the registry
    from . import corpus, textplans, features, learning, ingest, topics, experiments  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The oracle texts; one that cannot be built costs its own key only."""
    _load_all()
    found = {}
    for k, v in _ORACLES.items():
        try:
            found[k] = v() if callable(v) else v
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"no oracle for {k}: {e!r}", stacklevel=2)
    return found
