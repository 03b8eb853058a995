"""Masks and run lengths as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocellus.types.structs import COCO_RLE, POLYGON, RLE


def rle_encode(bits: Column) -> Column:
    """Run lengths of an array of 0/1, zeros first; empty for an empty array.

    The places where the value changes are found by a filter over the
    indices, so the cost is linear in the array.
    """
    n = F.size(bits)
    edges = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(bits, i) != F.get(bits, i - 1))
    bounds = F.concat(F.array(F.lit(0)), edges, F.array(n))
    runs = F.get(F.transform(F.array(bounds), lambda b: F.transform(F.slice(b, F.lit(2), F.size(b)), lambda x, i: x - F.get(b, i))), F.lit(0))
    leading = F.when(F.get(bits, F.lit(0)) != 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when(bits.isNotNull(), F.when(n > 0, F.concat(leading, runs)).otherwise(F.array().cast("array<int>")))


def rle_decode(counts: Column) -> Column:
    """The 0/1 values of run lengths, in their order."""
    return F.flatten(F.transform(counts, lambda n, i: F.array_repeat(i % 2, n)))


def to_column_major(bits: Column, height: Column, width: Column) -> Column:
    """Row-major values of a (height, width) mask given column by column."""
    order = F.transform(F.sequence(F.lit(0), F.greatest(height * width, F.lit(1)) - 1), lambda i: F.get(bits, (i % width) * height + F.floor(i / width).cast("int")))
    return F.when(height * width > 0, order).otherwise(F.array().cast("array<int>"))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def to_mask(mask: Column) -> Column:
    """Row-major 0/1 values of a run-length mask; null for polygons, which :func:`rasterize` fills."""
    bits = rle_decode(mask["rle"])
    columns = let(bits, lambda b: to_column_major(b, mask["height"], mask["width"]))
    return F.when(mask["type"] == RLE, bits).when(mask["type"] == COCO_RLE, columns)


def mask_iou(a: Column, b: Column) -> Column:
    """Common over all pixels of two run-length masks; 0 if there are none."""
    pairs = F.zip_with(to_mask(a), to_mask(b), lambda x, y: F.struct((x * y).alias("i"), F.greatest(x, y).alias("u")))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("u"))
    sums = F.aggregate(pairs, start, lambda s, p: F.struct((s["i"] + p["i"]).alias("i"), (s["u"] + p["u"]).alias("u")), lambda s: F.when(s["u"] > 0, s["i"] / s["u"]).otherwise(F.lit(0.0)))
    return F.when(a.isNotNull() & b.isNotNull(), sums)


def mask_from_rle(counts: Column, height: Column, width: Column, code: int = RLE) -> Column:
    return F.struct(F.lit(code).alias("type"), height.cast("int").alias("height"), width.cast("int").alias("width"), F.lit(None).cast("array<array<float>>").alias("polygon"), counts.cast("array<int>").alias("rle"))


def mask_from_coco_rle(counts: Column, height: Column, width: Column) -> Column:
    return mask_from_rle(counts, height, width, COCO_RLE)


def mask_from_polygon(polygon: Column, height: Column, width: Column) -> Column:
    return F.struct(F.lit(POLYGON).alias("type"), height.cast("int").alias("height"), width.cast("int").alias("width"), polygon.cast("array<array<float>>").alias("polygon"), F.lit(None).cast("array<int>").alias("rle"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _rasterized(masks: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    from ocellus.types.geometry import fill_polygons

    for batch in masks:
        yield pd.Series([None if p is None else fill_polygons([np.asarray(x) for x in p], h, w).reshape(-1).tolist() for p, h, w in zip(batch["polygon"], batch["height"], batch["width"], strict=True)])


def rasterize(mask: Column) -> Column:
    """Row-major 0/1 values of any mask; polygons are filled by a vectorised UDF."""
    return F.coalesce(to_mask(mask), _rasterized(mask))


def runs_of(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values in tall data: keys, run number, value, first place and length.

    For masks with a row for each pixel, of any length: two windows over the
    same partitioning and one aggregation.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    changed = (F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True))).cast("int")
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return df.withColumn("_new", changed).withColumn("run", run).groupBy(*keys, "run", value).agg(F.min(order).alias("first"), F.count("*").alias("length"))
