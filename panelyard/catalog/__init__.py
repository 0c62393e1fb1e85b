"""Registered queries: each operator on the given tables, with the SQL that must agree."""

from panelyard.catalog import evaluation, features, models, scans, selection  # noqa: F401
from panelyard.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
