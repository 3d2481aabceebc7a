"""Collects the registered queries of the library.

A plan module calls `query(sql)` as a decorator over a function (spark, sf_dir) -> DataFrame; the function's name is the
query's name. `sql` is the same query for DuckDB over the driver's views, or None where SQL can't express it.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

FLAGSHIP = "q_bm25_topk"
MODULES = ("retrieval", "relational", "graph", "property_graph", "text", "answer", "rounds", "resolver", "gates", "documents", "streams", "resolution", "build", "audits", "versions")

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessera.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
