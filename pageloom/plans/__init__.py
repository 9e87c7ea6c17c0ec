"""Registered queries: operators applied to the given tables."""

from pageloom.plans import q_audit, q_content, q_expressions, q_library, q_lists, q_reading, q_selection, q_streams  # noqa: F401
from pageloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
