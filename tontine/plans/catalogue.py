"""All registered queries."""

from __future__ import annotations

from tontine.plans import lifecycle, monitoring, operations, risk, tables  # noqa: F401 - register on import
from tontine.plans.registry import QUERIES, SQL, Build


def queries() -> dict[str, Build]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
