"""Registered queries, each with its DuckDB twin where SQL can express it."""

from wattloom.queries.base import ORACLE, QUERIES
from wattloom.queries import alerts, audits, decisions, extras, meter, models, reliability, streams  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
