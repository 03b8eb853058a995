"""Registration of the functions in SQL.

Geometry and image constructors are SQL functions, which Catalyst inlines
into the query's own expressions; functions on files are Python functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ocellus.functions import io
from ocellus.workers import importable

_BOX = "STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>"
_IMAGE = "STRUCT<data: BINARY, uri: STRING>"
_SEGMENT = "STRUCT<start_fno: INT, end_fno: INT>"


def _made(fields: list[str], checks: str = "TRUE") -> str:
    """A box of four expressions of ``v``, if they make one."""
    x0, y0, x1, y1 = fields
    valid = f"size(v) = 4 AND {checks} AND 0 <= {x0} AND {x0} <= {x1} AND 0 <= {y0} AND {y0} <= {y1}"
    box = f"named_struct('xmin', {x0}, 'ymin', {y0}, 'xmax', {x1}, 'ymax', {y1})"
    return f"CASE WHEN v IS NULL THEN CAST(NULL AS {_BOX}) WHEN {valid} THEN {box} ELSE CAST(raise_error(concat('not a box: ', to_json(named_struct('values', v)))) AS {_BOX}) END"


_X, _Y, _W, _H = (f"get(v, {i})" for i in range(4))
_COMMON = "greatest(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin), 0D) * greatest(least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin), 0D)"
_AREA = "({0}.ymax - {0}.ymin) * ({0}.xmax - {0}.xmin)"
_UNION = f"({_AREA.format('a')} + {_AREA.format('b')} - {_COMMON})"
_NONE = "a IS NULL OR b IS NULL"

#: (name, parameters, result, body)
FUNCTIONS = [
    ("area", f"a {_BOX}", "DOUBLE", _AREA.format("a")),
    ("box_area", f"a {_BOX}", "DOUBLE", _AREA.format("a")),
    ("iou", f"a {_BOX}, b {_BOX}", "DOUBLE", f"CASE WHEN {_NONE} THEN NULL WHEN {_UNION} = 0 THEN double('NaN') ELSE {_COMMON} / {_UNION} END"),
    ("box_overlaps", f"a {_BOX}, b {_BOX}", "BOOLEAN", f"CASE WHEN {_NONE} THEN NULL ELSE {_COMMON} > 0 END"),
    ("box_intersect", f"a {_BOX}, b {_BOX}", _BOX, f"CASE WHEN {_NONE} OR {_COMMON} <= 0 THEN NULL ELSE named_struct('xmin', greatest(a.xmin, b.xmin), 'ymin', greatest(a.ymin, b.ymin), 'xmax', least(a.xmax, b.xmax), 'ymax', least(a.ymax, b.ymax)) END"),
    ("box2d", "v ARRAY<DOUBLE>", _BOX, _made([_X, _Y, _W, _H])),
    ("box2d_from_center", "v ARRAY<DOUBLE>", _BOX, _made([f"({_X} - {_W} / 2)", f"({_Y} - {_H} / 2)", f"({_X} + {_W} / 2)", f"({_Y} + {_H} / 2)"], f"{_W} >= 0 AND {_H} >= 0")),
    ("box2d_from_top_left", "v ARRAY<DOUBLE>", _BOX, _made([_X, _Y, f"({_X} + {_W})", f"({_Y} + {_H})"], f"{_W} >= 0 AND {_H} >= 0")),
    ("image", "u STRING", _IMAGE, "CASE WHEN u IS NOT NULL THEN named_struct('data', CAST(NULL AS BINARY), 'uri', u) END"),
    ("to_image", "u STRING", _IMAGE, "CASE WHEN u IS NOT NULL THEN named_struct('data', CAST(NULL AS BINARY), 'uri', u) END"),
    ("bytes_to_image", "d BINARY", _IMAGE, "CASE WHEN d IS NOT NULL THEN named_struct('data', d, 'uri', CAST(NULL AS STRING)) END"),
    ("rle_decode", "c ARRAY<INT>", "ARRAY<INT>", "flatten(transform(c, (n, i) -> array_repeat(i % 2, n)))"),
    ("segment", "s INT, e INT", _SEGMENT, f"CASE WHEN s IS NULL OR e IS NULL THEN NULL WHEN s >= 0 AND (e < 0 OR e >= s) THEN named_struct('start_fno', s, 'end_fno', e) ELSE CAST(raise_error('not a segment') AS {_SEGMENT}) END"),
]


def register_functions(spark: SparkSession) -> list[str]:
    """Registers all functions in a session; their names."""
    importable(spark)
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    python = {"copy": io.copy, "image_copy": io.image_copy, "numpy_to_image": io.numpy_to_image, "crop": io.crop, "video_probe": io.probe, "spectrogram_image": io.spectrogram_image}
    for name, function in python.items():
        spark.udf.register(name, function)
    return [f[0] for f in FUNCTIONS] + list(python)


def to_struct(column):
    """A semantic value as its struct; semantic values are structs already."""
    return column
