"""SQL with the same results as the queries, for an independent engine over the same tables."""

from __future__ import annotations

from catalogue.sql import cleaning, eda, flat, measures, rfm, service, star


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in (flat, star, service, rfm, eda, measures, cleaning):
        found |= module.SQL
    return found
