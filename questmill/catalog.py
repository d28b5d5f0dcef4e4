"""All queries of the question library by name, and their DuckDB SQL."""

from __future__ import annotations

from questmill.plans import crop_queries, export_queries, figure_queries, library_queries, model_queries, sink_queries, solver_queries, state_queries, text_queries, validation_queries
from questmill.plans.library_queries import flagship

_PLANS = [crop_queries, figure_queries, library_queries, model_queries, sink_queries, solver_queries, state_queries, text_queries, export_queries, validation_queries]
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _plan in _PLANS:
    QUERIES |= _plan.QUERIES
    ORACLE_SQL |= _plan.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
