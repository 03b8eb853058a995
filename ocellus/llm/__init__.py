"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` holds the thin queries
that apply them to the test tables.
"""
