"""The named queries of the library: name -> query, and name -> equivalent SQL where there is one."""

from __future__ import annotations

from subjectlens.plans import answers, files, inference, knowledge, lateral, parsing, registry, requests, search, text  # noqa: F401  the modules register their queries


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
