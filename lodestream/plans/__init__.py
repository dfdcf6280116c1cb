"""Whole queries with their SQL."""

from lodestream.plans.queries import ENTRY, QUERIES, SQL

__all__ = ["ENTRY", "QUERIES", "SQL"]
