"""Independent SQL for every registered query, run by DuckDB on the same tables."""

from oracle.queries import oracle_queries

__all__ = ["oracle_queries"]
