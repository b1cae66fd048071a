"""The registered queries and the SQL they are checked against."""

from attestry.plans import ast, evidence, graphs, numbers, screens, sources  # noqa: F401
from attestry.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
