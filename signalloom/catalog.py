"""Registered queries and their SQL equivalents."""

from .plans import choice, market, scans, sweeps, wallet  # noqa: F401  register their queries
from .plans.core import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
