"""Queries for the driver contract, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

from labelspark.plans import column_queries, fixture_queries, io_queries, report_queries, star_queries, table_queries, text_queries
from labelspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "column_queries", "fixture_queries", "io_queries", "report_queries", "star_queries", "table_queries", "text_queries"]
