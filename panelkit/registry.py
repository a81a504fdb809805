"""All queries of the library by name, with their SQL counterparts; ``panelkit.plans`` fills both."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame, with its DuckDB counterpart where SQL can express it."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
