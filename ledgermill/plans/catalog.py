"""Queries and oracle SQL of the core operators, by name."""

from __future__ import annotations

from ledgermill.plans import evidence, lifecycle, results, rules, store, training, workflow  # noqa: F401  (registration)
from ledgermill.plans.common import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
