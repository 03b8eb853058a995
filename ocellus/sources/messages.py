"""Robot messages: typed fields to Spark schemas and dicts.

A message class has ``_slot_types`` and ``__slots__``; nested types are looked
up by a function, so no robotics package is needed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import types as T

#: Spark types of primitive field types.
PRIMITIVES = {
    "bool": T.BooleanType(), "char": T.ByteType(), "int8": T.ByteType(), "byte": T.ByteType(), "int16": T.ShortType(), "uint8": T.ShortType(), "int32": T.IntegerType(), "uint16": T.IntegerType(),
    "int64": T.LongType(), "uint32": T.LongType(), "uint64": T.LongType(), "duration": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(), "time": T.TimestampType(),
}
_ARRAY = re.compile(r"^(?P<item>[^\[\]]+)\[\d*\]$")
Lookup = Callable[[str], Any]


def spark_type(name: str, lookup: Lookup) -> T.DataType:
    """Spark type of a field type; byte[] and uint8[] are binary."""
    if found := _ARRAY.match(name):
        item = found["item"]
        return T.BinaryType() if item in ("byte", "uint8") else T.ArrayType(spark_type(item, lookup))
    return PRIMITIVES[name] if name in PRIMITIVES else schema_of(lookup(name), lookup)


def schema_of(message: Any, lookup: Lookup) -> T.StructType:
    """Spark schema of a message class."""
    return T.StructType([T.StructField(f, spark_type(k, lookup)) for f, k in zip(message.__slots__, message._slot_types, strict=True)])


def _value(value: Any, kind: str) -> Any:
    if value is None:
        return None
    if found := _ARRAY.match(kind):
        return bytes(value) if found["item"] in ("byte", "uint8") else [_value(v, found["item"]) for v in value]
    if kind == "time":
        return datetime.fromtimestamp(value.secs, UTC).replace(microsecond=value.nsecs // 1000)
    if kind == "duration":
        return value.secs * 1_000_000_000 + value.nsecs
    return value if kind in PRIMITIVES else to_dict(value)


def to_dict(message: Any) -> dict[str, Any]:
    """A message as nested dicts: times as datetimes, durations as nanoseconds, bytes as bytes."""
    return {f: _value(getattr(message, f), k) for f, k in zip(message.__slots__, message._slot_types, strict=True)}


def to_json_dict(message: Any) -> dict[str, Any]:
    """The same, with durations as seconds."""
    out = {}
    for f, k in zip(message.__slots__, message._slot_types, strict=True):
        value = getattr(message, f)
        nested = k not in PRIMITIVES and not _ARRAY.match(k)
        out[f] = value.secs + value.nsecs / 1e9 if k == "duration" else to_json_dict(value) if nested else _value(value, k)
    return out
