"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from riskweave.plans import claims, learning, retrieval, scoring, security

_PACKS = [claims, security, scoring, retrieval, learning]


def queries() -> dict:
    return {name: run for pack in _PACKS for name, run in pack.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for pack in _PACKS for name, sql in pack.ORACLES.items()}
