"""All queries of the library's own operators."""

from __future__ import annotations

from . import curve_queries, join_queries, physics_queries, plume_queries, sampling_queries, scalar_queries, select_queries, source_queries  # noqa: F401
from .bindings import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
