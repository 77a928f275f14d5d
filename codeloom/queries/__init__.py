"""The queries of the library's operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from codeloom.queries import functions, graph, parsing, retrieval, service, sources

_MODULES = (sources, functions, parsing, graph, retrieval, service)


def queries() -> dict:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
