"""Queries over the shipped tables and the SQL they are checked against."""

from __future__ import annotations

from callbook.queries import calls, extraction, fundamentals, lenses, more, signals, strategies, tables, technical, zones  # noqa: F401
from callbook.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
