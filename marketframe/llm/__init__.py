"""Operators for large training-data pipelines, and their registered queries."""

from marketframe.llm.entry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
