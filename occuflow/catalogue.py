"""All occupancy queries and their SQL twins."""

from __future__ import annotations

from .plans import audits, clock, domain, evaluation, fares, files, grids, joins, model, predicates, quality, reports, rules, scoring, service, serving, statistics, stream, tables  # noqa: F401
from .registry import QUERIES, SQL, Query

FLAGSHIP = "persistence_error"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
