"""Operators for large training corpora.  Nothing outside this subpackage imports it, except the guarded entry point."""

from rheolake.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
