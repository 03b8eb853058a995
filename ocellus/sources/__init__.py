"""Datasets, files and converters."""

from ocellus.sources.dataset import Dataset, read_dataset, write_dataset, write_pandas

__all__ = ["Dataset", "read_dataset", "write_dataset", "write_pandas"]
