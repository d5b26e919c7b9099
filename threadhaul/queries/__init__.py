"""Every operator as a query over the given tables, with its check in SQL."""

from __future__ import annotations

# Importing a module registers its queries.
from . import admin, files, functions, merges, metrics, pages, streams, worklist  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
