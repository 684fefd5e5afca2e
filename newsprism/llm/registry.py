"""Registry of the subpackage's queries (operator modules register on import)."""

from __future__ import annotations

import importlib

MODULES = ("fertility", "bpe_rounds", "path_join", "suffix_repeats", "byte_gru", "bestfit", "kd_shards",
           "toxicity", "segment_search", "kneser_ney", "lcp_runs", "fm_index", "turn_repair")

_QUERIES: dict = {}
_ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_ORACLES)
