"""All queries of the library's own operators and the SQL they must agree with."""

from __future__ import annotations

from . import io_queries, media_queries, record_queries, text_queries  # noqa: F401  they register themselves
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
