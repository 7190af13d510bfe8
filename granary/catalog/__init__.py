"""Registered queries, grouped by topic."""

from granary.catalog import chunks, contexts, flows, graphs, ranking, routes, search, texts  # noqa: F401
from granary.catalog.base import CHECKS, QUERIES, check_sql

ORACLES = {name: check_sql(sql) for name, sql in CHECKS.items()}

__all__ = ["ORACLES", "QUERIES"]
