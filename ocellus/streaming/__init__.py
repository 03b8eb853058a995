"""Streams: what the library's functions and models do, over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ocellus.sql.engine import Engine


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is that of the files there now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def windowed(events: DataFrame, time: str, window: str, keys: list[str], late: str, *aggregates, slide: str | None = None) -> DataFrame:
    """Aggregates of each key in tumbling or sliding windows; rows later than ``late`` are left out."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, late).groupBy(span.alias("window"), *keys).agg(*aggregates)


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str, *aggregates) -> DataFrame:
    """Aggregates of each key's sessions, which end after ``gap`` without a row."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*aggregates)


def predicted(events: DataFrame, engine: Engine, model: str, *columns: str) -> DataFrame:
    """A stream with a model's predictions."""
    return events.withColumn(model, engine.predict(model, *columns))


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream to a Parquet folder, exactly once for each checkpoint."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


#: The conf of a stream's state store, and one that keeps state on disk.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_complete(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs an aggregated stream over the data there is now; its whole result becomes a Parquet folder.

    Executors write the result and hold the groups on disk, so neither has to
    fit in memory; a memory sink would bring all groups to the driver.
    """
    conf = df.sparkSession.conf
    kept = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, DISK_STATE)
    try:
        writer = df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    finally:
        conf.unset(STATE_STORE) if kept is None else conf.set(STATE_STORE, kept)
