"""Every registered query of the core library."""

from __future__ import annotations

from . import documents, events, mining, tables, vectors

FLAGSHIP = "doc_repeat_clusters"
MODULES = (events, documents, vectors, tables, mining)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
