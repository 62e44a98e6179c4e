"""Registry of the engine's own queries and of their SQL twins."""

from __future__ import annotations

from .plans import analytics, base, jobs, layouts, models, more, network, relational

__all__ = ["analytics", "base", "jobs", "layouts", "models", "more", "network", "oracle_sql", "queries", "relational"]


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.SQL)
