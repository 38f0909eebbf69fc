"""All register queries."""

from ledgerloom.plans import load_queries, queries, recovery_queries, search_queries  # noqa: F401  (each registers its own)
from ledgerloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
