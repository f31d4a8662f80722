"""Registered queries over the driver tables, each beside its SQL."""

from __future__ import annotations

from . import derived, extraction, indexed, knowledge, retrieval, rows, rules, services, statistics

_MODULES = (statistics, rows, retrieval, knowledge, services, extraction, indexed, derived, rules)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.R.oracles.items()}
