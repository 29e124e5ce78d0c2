"""Registered queries over the given tables, each next to its SQL."""

from . import feeds, grids, repair, serving, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
