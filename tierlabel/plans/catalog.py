"""All registered queries."""

from tierlabel.plans import evaluation_queries, table_queries, vector_queries  # noqa: F401
from tierlabel.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
