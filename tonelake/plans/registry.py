"""All queries of the music engine with their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("q_timeline", "q_theory", "q_chords", "q_edits", "q_metrics", "q_formats", "q_play", "q_text", "q_stream", "q_omr", "q_systems", "q_pages", "q_tuplets", "q_readers", "q_words")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the SQL that gives the same rows if there is any."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
