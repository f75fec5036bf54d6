"""Queries over the driver tables and their SQL."""

from . import file_queries, table_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
