"""All queries of the mesh side, one per operator or group of operators."""

from __future__ import annotations

from quadrille.plans import queries_extraction, queries_kernels, queries_mesh, queries_more

_MODULES = (queries_mesh, queries_more, queries_kernels, queries_extraction)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
