"""All queries of the reference scope with their SQL."""

from __future__ import annotations

from siltstone.plans import io_queries, registry


def queries() -> dict[str, registry.Query]:
    """Every query by name; importing io_queries has added its own to the registry."""
    return registry.queries() if io_queries.LOADED else {}


def oracle_sql() -> dict[str, str]:
    return registry.oracle_sql()
