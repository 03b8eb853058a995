"""Operators as Column builders and DataFrame transformations."""
