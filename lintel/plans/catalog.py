"""Import every query module so that the registry is complete."""

from __future__ import annotations

from lintel.plans import q_rollups  # noqa: F401  (first: the bundle reuses its oracle SQL)
from lintel.plans import q_rules, q_fits, q_joins, q_models, q_text  # noqa: F401
from lintel.plans import q_history, q_reports, q_keyword  # noqa: F401
from lintel.plans.registry import OPERATORS, ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE", "OPERATORS"]
