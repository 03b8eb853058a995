"""Small helpers that the Arrow-based operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, where the session sets none: JVM and worker hold some batches each for every core.
BATCH_BYTES = "4MB"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_TIDY_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Characters of text that are handled at once inside a Python worker.
SLICE_CHARS = 2_000_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def give_back() -> None:
    """Returns this process's free memory to the machine; Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes, and free memory given back after each task."""
    if df.sparkSession.conf.get(_BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(_BATCH_SETTING, BATCH_BYTES)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(released, schema)


def hash_sample(df: DataFrame, columns: list[str], sample: int, total: int) -> DataFrame:
    """The up to ``sample`` rows with the smallest hashes of ``columns``, of a table with ``total`` rows.

    Rows far beyond the cut are dropped where they are read, so that each task
    hands on few.  With very many equal rows there may be fewer than ``sample``.
    """
    key = F.xxhash64(*columns)
    if total > 2 * sample:
        df = df.where(key <= int(-(2**63) + 2**64 * (2 * sample / total)))
    return df.orderBy(key, *columns).limit(sample)


def slices(batch: pa.RecordBatch, text: str, chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of a batch with their first row; null texts are empty.

    A run ends once it holds ``chars`` characters, so Python objects of one
    run only are alive at a time; a longer text is a run of its own.
    """
    column = batch.column(batch.schema.get_field_index(text))
    first, run, size = 0, [], 0
    for row, value in enumerate(column):
        run.append(value.as_py() or "")
        size += len(run[-1])
        if size >= chars:
            yield first, run
            first, run, size = row + 1, [], 0
    if run:
        yield first, run


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session has no such setting and runs on one machine (as in
    tests) a local folder is used instead; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        spark.sparkContext.setCheckpointDir("/tmp/ocellus-checkpoints")
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/ocellus-{uuid.uuid4().hex}"


def written(df: DataFrame, tidy: bool = False) -> DataFrame:
    """``df`` as a table written once to the shared folder; cuts the lineage.

    If ``tidy``, the write's shuffle files go once it ends; else they stay
    until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    schema = df.schema
    before = spark.conf.get(_TIDY_SETTING, None)
    if tidy:
        spark.conf.set(_TIDY_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_TIDY_SETTING) if before is None else spark.conf.set(_TIDY_SETTING, before)
    out = spark.read.schema(schema).parquet(path)
    out._ocellus_folder = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`written`."""
    spark = df.sparkSession
    # Spark has no public way to delete files in the folder's file system.
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(df._ocellus_folder)
    path.getFileSystem(conf).delete(path, True)
