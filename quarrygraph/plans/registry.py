"""Named queries: name -> (function of session and folder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        _ALL[f.__name__] = (f, sql)
        return f

    return add


def _load() -> None:
    from quarrygraph.plans import coded, flagship, graphical, model, modelled, relational, running, wider  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _ALL.items() if s}
