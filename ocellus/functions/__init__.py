"""Functions for SQL: ``register_functions(spark)``."""

from ocellus.functions.register import register_functions

__all__ = ["register_functions"]
