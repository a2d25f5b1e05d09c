"""Registered queries of the contract and record operators, with their SQL."""

from __future__ import annotations

from . import check_queries, diff_queries, record_queries, rollup_queries, scalar_queries, surface_queries  # noqa: F401  they register their queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
