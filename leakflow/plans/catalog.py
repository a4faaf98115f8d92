"""All queries of the package by name, with the SQL that says what they return."""

from __future__ import annotations

from leakflow.plans import commands, documents, events, graphs, pages, stores  # noqa: F401
from leakflow.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
