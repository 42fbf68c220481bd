"""All registered queries of the library with their independent SQL."""

from __future__ import annotations

from . import context, more, reports, search, streams, summaries  # noqa: F401  (they register their queries)
from .security import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
