"""Registered queries and their SQL."""

from __future__ import annotations

from lithic.plans import containers, drillholes, ensembles, grids, looks, processes, traces

MODULES = (drillholes, grids, ensembles, traces, looks, processes, containers)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
