"""All queries of the library, and SQL twins for DuckDB."""

from __future__ import annotations

from feedloom.plans import choices, depth, jobs, ladders, more, rules, scans, tables  # noqa: F401
from feedloom.plans.base import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "rul1_opportunity"
