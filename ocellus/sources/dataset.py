"""Datasets: Parquet folders with a metadata sidecar."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ocellus.conf import get_option
from ocellus.errors import ColumnNotFoundError
from ocellus.sources.resolver import resolver_of
from ocellus.sources.uri import exists, normalize, read_bytes, write_bytes
from ocellus.types.views import plain, to_view

SIDECAR = "_ocellus/metadata.json"
#: Footers that are read at a time.
FOOTER_READERS = 32
#: Bytes of row groups (uncompressed) that one partition of a row-group scan reads at least, where its file has as many.
SCAN_BYTES = 8 * 1024 * 1024
#: Rows between checks of a row group's size.
ROW_CHECKS = {"parquet.page.size.row.check.min": "3", "parquet.page.size.row.check.max": "32"}


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None, block_size: int | None = None, max_rows_per_file: int | None = None, **options: Any) -> None:
    """Writes a DataFrame with small row groups and a sidecar of its options (as strings).

    ``mode`` is Spark's, or ``delete_matching``: overwrite only the partitions
    that the rows belong to.
    """
    size = int(block_size or get_option("block_size"))
    writer = df.write.options(**ROW_CHECKS).option("parquet.block.size", str(size))
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", str(max_rows_per_file))
    if mode == "delete_matching":
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    shown = {k: (str(v).lower() if isinstance(v, bool) else str(v)) for k, v in options.items()}
    write_bytes(f"{normalize(path).rstrip('/')}/{SIDECAR}", json.dumps({"options": shown}).encode())


def save_as_table(df: DataFrame, name: str, **options: Any) -> None:
    """A managed Parquet table with small row groups."""
    df.write.format("parquet").options(**ROW_CHECKS).option("parquet.block.size", str(get_option("block_size"))).options(**options).mode("overwrite").saveAsTable(name)


def read_dataset(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A dataset as a DataFrame; a missing column is an error."""
    df = spark.read.parquet(path)
    if columns is None:
        return df
    for c in columns:
        if c not in df.columns:
            raise ColumnNotFoundError(f"no column {c!r} in {path}; there are {df.columns}")
    return df.select(*columns)


def write_pandas(spark: SparkSession, frame: pd.DataFrame, path: str, schema: T.StructType, partition_by: list[str] | None = None, max_rows_per_file: int | None = None, mode: str = "error") -> None:
    """Writes a pandas DataFrame whose cells may hold views; mode is error, overwrite_or_ignore or delete_matching."""
    modes = {"error": "error", "overwrite_or_ignore": "append", "delete_matching": "delete_matching"}
    if mode not in modes:
        raise ValueError(f"mode must be one of {sorted(modes)}")
    rows = [tuple(plain(v) for v in row) for row in frame[schema.fieldNames()].itertuples(index=False)]
    write_dataset(spark.createDataFrame(rows, schema), path, modes[mode], partition_by, max_rows_per_file=max_rows_per_file)


class Dataset:
    """A dataset read outside of Spark's engine, row group by row group.

    ``offset`` skips that many rows of the whole dataset; of the row groups
    that are left, those with ``number % world_size == rank`` are read.
    """

    def __init__(self, uri: str, columns: list[str] | None = None, offset: int = 0, rank: int = 0, world_size: int = 1):
        if offset < 0:
            raise ValueError("the offset must not be negative")
        if not 0 <= rank < world_size:
            raise ValueError("the rank must be in the world")
        self.uri, self.columns, self.offset, self.rank, self.world_size = uri, columns, offset, rank, world_size
        resolver = resolver_of(uri)
        self.files = resolver.resolve(uri)
        self.spark_schema = resolver.schema(uri) if self.files else T.StructType()
        for c in columns or []:
            if c not in self.spark_schema.fieldNames():
                raise ColumnNotFoundError(f"no column {c!r} in {uri}")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.spark_schema if self.columns is None or f.name in self.columns])

    @property
    def metadata(self) -> dict:
        """The sidecar's content; empty if there is none."""
        at = f"{normalize(self.uri).rstrip('/')}/{SIDECAR}"
        return json.loads(read_bytes(at)) if exists(at) else {}

    def _open(self, uri: str) -> pq.ParquetFile:
        place, path = fs.FileSystem.from_uri(uri)
        return pq.ParquetFile(place.open_input_file(path))

    def __len__(self) -> int:
        return self.count()

    def _group_sizes(self, uri: str) -> list[tuple[int, int]]:
        meta = self._open(uri).metadata
        found = [meta.row_group(g) for g in range(meta.num_row_groups)]
        return [(g.num_rows, g.total_byte_size) for g in found]

    def footers(self) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Each file with the rows and bytes of its row groups, in order; many footers are read at a time."""
        with ThreadPoolExecutor(FOOTER_READERS) as readers:
            yield from zip(self.files, readers.map(self._group_sizes, self.files), strict=True)

    def count(self) -> int:
        """Rows by the files' footers."""
        return sum(rows for _, sizes in self.footers() for rows, _ in sizes)

    def groups(self) -> Iterator[tuple[str, int, int]]:
        """(file, row group, rows to skip in it) of this rank."""
        for uri, group, skip, _ in self._sized_groups():
            yield uri, group, skip

    def bundles(self, least: int = SCAN_BYTES) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """(file, its row groups with rows to skip) of this rank, ``least`` bytes or more together unless the file ends."""
        found: list[tuple[int, int]] = []
        of, total = "", 0
        for uri, group, skip, size in self._sized_groups():
            if found and (uri != of or total >= least):
                yield of, found
                found, total = [], 0
            found.append((group, skip))
            of, total = uri, total + size
        if found:
            yield of, found

    def _sized_groups(self) -> Iterator[tuple[str, int, int, int]]:
        skip, number = self.offset, 0
        for uri, sizes in self.footers():
            for g, (rows, size) in enumerate(sizes):
                if skip >= rows:
                    skip -= rows
                    continue
                if number % self.world_size == self.rank:
                    yield uri, g, skip, size
                number, skip = number + 1, 0

    def __iter__(self) -> Iterator[dict[str, Any]]:
        schema = self.schema
        names = schema.fieldNames()
        for uri, group, skip in self.groups():
            table = self._open(uri).read_row_group(group, columns=names).slice(skip)
            for batch in table.to_batches(max_chunksize=256):
                for row in batch.to_pylist():
                    yield {f.name: to_view(row[f.name], f.dataType) for f in schema}

    def to_pandas(self, limit: int | None = None) -> pd.DataFrame:
        """All rows, or the first ``limit`` if it is positive."""
        rows = []
        for row in self:
            rows.append(row)
            if limit and limit > 0 and len(rows) >= limit:
                break
        return pd.DataFrame(rows, columns=self.schema.fieldNames())


class _Groups(InputPartition):
    def __init__(self, number: int, uri: str, groups: list[tuple[int, int]]):
        super().__init__(number)
        self.uri, self.groups = uri, groups


class _GroupReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.names = schema.fieldNames()
        self.data = Dataset(options["path"], offset=int(options.get("offset", 0)), rank=int(options.get("rank", 0)), world_size=int(options.get("world_size", 1)))

    def partitions(self) -> list[InputPartition]:
        return [_Groups(i, *b) for i, b in enumerate(self.data.bundles())] or [_Groups(0, "", [])]

    def read(self, partition: _Groups):
        if partition.uri:
            # The file and its footer, which has an entry for every row group, are read once.
            place, path = fs.FileSystem.from_uri(partition.uri)
            file = pq.ParquetFile(place.open_input_file(path))
            for group, skip in partition.groups:
                yield from file.read_row_group(group, columns=self.names).slice(skip).to_batches()


class RowGroupSource(DataSource):
    """``spark.read.format("ocellus_groups")``: the row groups of a rank, small ones of a file together in a partition.

    Options: path, columns (comma-separated; all by default), offset, rank,
    world_size.  Only those columns are read.  Batches go to the JVM as Arrow.
    """

    @classmethod
    def name(cls) -> str:
        return "ocellus_groups"

    def schema(self) -> T.StructType:
        whole = resolver_of(self.options["path"]).schema(self.options["path"])
        columns = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        for c in columns:
            if c not in whole.fieldNames():
                raise ColumnNotFoundError(f"no column {c!r} in {self.options['path']}")
        return T.StructType([whole[c] for c in columns]) if columns else whole

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _GroupReader(schema, dict(self.options))


def sharded(spark: SparkSession, path: str, rank: int, world_size: int, offset: int = 0, columns: list[str] | None = None) -> DataFrame:
    """The row groups of a rank as a DataFrame, with all columns or those named."""
    spark.dataSource.register(RowGroupSource)
    return spark.read.format("ocellus_groups").options(path=path, rank=rank, world_size=world_size, offset=offset, columns=",".join(columns or [])).load()
