"""Semantic types, model inference and dataset tooling on PySpark."""

__version__ = "0.1.0"
