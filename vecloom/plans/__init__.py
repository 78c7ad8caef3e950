"""Registered queries over the stored tables."""

from vecloom.plans import migration, requestlog, search, streams, tables, text, validate
from vecloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "migration", "requestlog", "search", "streams", "tables", "text", "validate"]
