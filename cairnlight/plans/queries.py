"""All queries of the core with their SQL."""

from __future__ import annotations

from cairnlight.plans import cohort, context, evaluation, knowledge, quality, relational, retrieval, review, storage  # noqa: F401  (they register their queries)
from cairnlight.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
