"""All registered queries."""

from promptframe.plans import answer_queries, grid_queries, store_queries  # noqa: F401
from promptframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
