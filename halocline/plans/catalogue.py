"""All queries of the package, by name."""

from __future__ import annotations

from . import batches, chain, fields, profiles, serving, skill, times  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
