"""Spark types of the semantic types: plain structs, so their fields work in SQL everywhere."""

from __future__ import annotations

from pyspark.sql import types as T


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType(), False) for n in names]


BOX2D = T.StructType(_doubles("xmin", "ymin", "xmax", "ymax"))
POINT = T.StructType(_doubles("x", "y", "z"))
BOX3D = T.StructType([T.StructField("center", POINT, False), *_doubles("length", "width", "height", "heading")])
MASK = T.StructType(
    [
        T.StructField("type", T.IntegerType(), False),
        T.StructField("height", T.IntegerType(), False),
        T.StructField("width", T.IntegerType(), False),
        T.StructField("polygon", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("rle", T.ArrayType(T.IntegerType())),
    ]
)
IMAGE = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("uri", T.StringType())])
NDARRAY = T.StructType([T.StructField("dtype", T.StringType(), False), T.StructField("shape", T.ArrayType(T.IntegerType()), False), T.StructField("data", T.BinaryType(), False)])
YOUTUBE_VIDEO = T.StructType([T.StructField("vid", T.StringType(), False)])
VIDEO_STREAM = T.StructType([T.StructField("uri", T.StringType(), False)])
SEGMENT = T.StructType([T.StructField("start_fno", T.IntegerType(), False), T.StructField("end_fno", T.IntegerType(), False)])

#: Names in the schema language.
NAMED_TYPES = {"box2d": BOX2D, "point": POINT, "box3d": BOX3D, "mask": MASK, "image": IMAGE, "ndarray": NDARRAY, "videostream": VIDEO_STREAM, "youtubevideo": YOUTUBE_VIDEO, "segment": SEGMENT}
#: Codes of a mask's ``type``.
POLYGON, RLE, COCO_RLE = 1, 2, 3


def same_fields(a: T.DataType, b: T.DataType) -> bool:
    """Whether two types agree up to nullability."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return [f.name for f in a] == [f.name for f in b] and all(same_fields(x.dataType, y.dataType) for x, y in zip(a, b, strict=True))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return same_fields(a.elementType, b.elementType)
    return a == b


def name_of(kind: T.DataType) -> str | None:
    """The semantic type that a struct is, if any."""
    return next((name for name, s in NAMED_TYPES.items() if same_fields(s, kind)), None)
