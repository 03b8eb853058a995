"""Resolvers: from a dataset's URI to its Parquet files and schema."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from urllib.parse import urlparse

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.types import StructType

from ocellus.sources.uri import normalize

#: Fixed value: Spark's schema in a Parquet footer.
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


class Resolver(ABC):
    @abstractmethod
    def resolve(self, uri: str) -> list[str]:
        """URIs of the dataset's files, in order."""

    @abstractmethod
    def schema(self, uri: str) -> StructType:
        """The dataset's Spark schema."""


class FolderResolver(Resolver):
    """All ``*.parquet`` files below a folder (hidden and ``_`` folders aside), sorted."""

    def _files(self, uri: str) -> tuple[fs.FileSystem, list[str]]:
        place, path = fs.FileSystem.from_uri(normalize(uri).rstrip("/"))
        info = place.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(uri)
        if info.type == fs.FileType.File:
            return place, [path]
        found = place.get_file_info(fs.FileSelector(path, recursive=True))
        inner = lambda p: p[len(path) :].split("/")
        return place, sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and not any(x.startswith(("_", ".")) for x in inner(f.path)))

    def resolve(self, uri: str) -> list[str]:
        scheme = urlparse(normalize(uri)).scheme
        return [f"{scheme}://{p}" for p in self._files(uri)[1]]

    def schema(self, uri: str) -> StructType:
        place, files = self._files(uri)
        if not files:
            raise ValueError(f"{uri} has no Parquet files")
        with place.open_input_file(files[0]) as f:
            meta = pq.ParquetFile(f).metadata.metadata or {}
        if SPARK_SCHEMA not in meta:
            raise ValueError(f"{uri} was not written by Spark: its footer has no schema")
        return StructType.fromJson(json.loads(meta[SPARK_SCHEMA]))


_resolvers: dict[str, Resolver] = {}
_default = FolderResolver()


def register(scheme: str, resolver: Resolver) -> None:
    """Adds a resolver for a scheme; one that is there already is an error."""
    if scheme in _resolvers:
        raise KeyError(f"there is a resolver for {scheme!r}")
    _resolvers[scheme] = resolver


def unregister(scheme: str) -> None:
    _resolvers.pop(scheme, None)


def resolver_of(uri: str) -> Resolver:
    return _resolvers.get(urlparse(str(uri)).scheme, _default)
