"""All registered queries of the library and their SQL."""

from __future__ import annotations

from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
