"""Queries of the engine itself and their oracles."""

from __future__ import annotations

FLAGSHIP = "a1_stats"


def queries() -> dict:
    from tracemark.plans import queries as q

    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    from tracemark.plans import queries as q

    return dict(q.ORACLES)
