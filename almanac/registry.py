"""One place where a query's name meets its Spark function and the SQL that it must equal."""

from __future__ import annotations


def queries() -> dict:
    from .plans import files  # noqa: F401  registers its queries
    from .plans.queries import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .plans.sql import ORACLES

    return dict(ORACLES)
