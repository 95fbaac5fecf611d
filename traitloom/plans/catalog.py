"""All registered queries."""

from . import answer_queries, compare_queries, run_queries, schema_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
