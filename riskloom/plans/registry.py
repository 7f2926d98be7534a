"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from . import assembly, chains, checks, findings, graph, history, metrics, models, policy, sequences, serving, splits, streams  # noqa: F401
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
