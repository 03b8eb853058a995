"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` that has the same key and no later time.

    Both sides are one table, dealt and sorted by key once, in which each left
    row takes the last right row before it, so no pairs are made.  Of right
    rows with equal times the one with the largest values counts.  Left rows
    without such a row, or with a null key or time, have nulls.
    """
    names = left.columns
    side = F.struct(*[F.col(v) for v in values])
    marked = left.withColumn("_ocellus_right", F.lit(None).cast(right.select(side.alias("s")).schema["s"].dataType))
    other = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, time).agg(F.max(side).alias("_ocellus_right"))
    both = marked.withColumn("_ocellus_left", F.lit(True)).unionByName(other.withColumn("_ocellus_left", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.col(time), F.col("_ocellus_left")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_ocellus_found", F.last("_ocellus_right", ignorenulls=True).over(order)).where("_ocellus_left")
    valid = F.col(key).isNotNull() & F.col(time).isNotNull()
    return found.select(*names, *[F.when(valid, F.col("_ocellus_found")[v]).alias(v) for v in values])
