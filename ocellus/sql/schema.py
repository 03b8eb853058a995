"""The schema language of models: STRUCT<name:type, ...>, ARRAY<type>, and type names."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from ocellus.errors import SchemaError
from ocellus.types.structs import NAMED_TYPES

#: Names of primitive types; any case is accepted.
PRIMITIVES = {
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "byte": T.ByteType(), "tinyint": T.ByteType(), "short": T.ShortType(), "smallint": T.ShortType(), "int": T.IntegerType(), "integer": T.IntegerType(),
    "long": T.LongType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "str": T.StringType(), "string": T.StringType(), "binary": T.BinaryType(),
}
_TOKEN = re.compile(r"\s*(?:([A-Za-z_0-9]+)|(.))", re.S)


def parse_schema(text: str) -> T.DataType:
    """The Spark type that a text names; all fields are nullable.

    Types that the language lacks (maps, decimals, dates, ...) may be given as
    Spark DDL instead.
    """
    tokens = [a or b for a, b in _TOKEN.findall(text.strip())]
    if not tokens:
        raise SchemaError("Invalid schema: it is empty")
    at = 0

    def take(expected: str | None = None) -> str:
        nonlocal at
        if at == len(tokens) or expected is not None and tokens[at] != expected:
            raise SchemaError(f"Invalid schema {text!r}: expected {expected or 'more'} at {' '.join(tokens[at : at + 3]) or 'the end'}")
        at += 1
        return tokens[at - 1]

    def kind() -> T.DataType:
        name = take()
        low = name.lower()
        if low == "struct":
            take("<")
            fields = [field()]
            while tokens[at : at + 1] == [","]:
                take(",")
                fields.append(field())
            take(">")
            return T.StructType(fields)
        if low == "array":
            take("<")
            inner = kind()
            take(">")
            return T.ArrayType(inner)
        if name[0].isdigit():
            raise SchemaError(f"Invalid schema: {name!r} can not start with a digit")
        if low in PRIMITIVES or low in NAMED_TYPES:
            return PRIMITIVES.get(low) or NAMED_TYPES[low]
        raise SchemaError(f"Can not recognize type {name!r}")

    def field() -> T.StructField:
        name = take()
        if name[0].isdigit():
            raise SchemaError(f"Invalid schema: {name!r} can not start with a digit")
        take(":")
        return T.StructField(name, kind())

    try:
        out = kind()
        if at < len(tokens):
            raise SchemaError(f"Invalid schema {text!r}: {' '.join(tokens[at:])} is left over")
        return out
    except SchemaError:
        if re.search(r"\b(map|decimal|date|timestamp|timestamp_ntz|interval|variant)\b", text, re.I):
            return T._parse_datatype_string(text)
        raise


def schema_text(kind: T.DataType) -> str:
    """A type in the schema language."""
    if isinstance(kind, T.StructType):
        name = next((n for n, s in NAMED_TYPES.items() if s == kind), None)
        return name or f"STRUCT<{', '.join(f'{f.name}:{schema_text(f.dataType)}' for f in kind)}>"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{schema_text(kind.elementType)}>"
    return kind.simpleString()
