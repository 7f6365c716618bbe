"""Registered queries, by area."""

from . import accounts, churn, constructs, migration, orders, revenue, usage  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
