"""All queries of the library by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from .plans import activate, answer, apply, control, govern, indexes, ingest, notes, publish, retrieve, streams, verify  # noqa: F401  each registers its queries
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
