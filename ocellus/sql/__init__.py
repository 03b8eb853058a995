"""Models in SQL: a schema language, four statements, and prediction inside queries."""

from ocellus.sql.engine import Engine

__all__ = ["Engine"]
