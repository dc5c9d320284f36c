"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from costloom.plans import cost_queries, other_queries  # noqa: F401  they register their queries
from costloom.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
