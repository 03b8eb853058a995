"""Adapters to libraries that need not be installed."""
