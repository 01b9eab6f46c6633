"""Named queries over hub tables, each with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from .hub import Hub, oracle

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    from . import auth_q, facts_q, findings_q, graph_q, history_q, imports_q, incremental_q, index_q, lattice_q, more_q, names_q, patterns_q, snapshots_q, source_q, ssa_q, surface_q, text_q  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Hub(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: oracle(sql) for name, sql in _SQL.items()}
