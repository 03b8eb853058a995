"""Collected Spark values as Python views, recursively."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Row
from pyspark.sql import types as T

from ocellus.types.geometry import Box2d, Box3d, Mask, Point
from ocellus.types.structs import name_of
from ocellus.types.tensor import NDArray
from ocellus.types.video import Segment, VideoStream, YouTubeVideo
from ocellus.types.vision import Image

VIEWS = {"box2d": Box2d, "point": Point, "mask": Mask, "image": Image, "videostream": VideoStream, "youtubevideo": YouTubeVideo, "segment": Segment}


def to_view(value: Any, kind: T.DataType) -> Any:
    """A value of a Spark type with every semantic struct in it replaced by its view."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [to_view(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        fields = {f.name: value[f.name] for f in kind}
        name = name_of(kind)
        if name == "box3d":
            return Box3d(**fields | {"center": Point(**fields["center"].asDict() if isinstance(fields["center"], Row) else fields["center"])})
        if name == "ndarray":
            return NDArray(fields["dtype"], tuple(fields["shape"]), bytes(fields["data"])).to_numpy()
        if name == "image":
            return Image(**{k: bytes(v) if isinstance(v, bytearray) else v for k, v in fields.items()})
        if name in VIEWS:
            return VIEWS[name](**fields)
        return {f.name: to_view(fields[f.name], f.dataType) for f in kind}
    if isinstance(kind, T.UserDefinedType) and hasattr(value, "toArray"):
        return value.toArray()
    return value


def view_of(row: Row, schema: T.StructType) -> dict[str, Any]:
    """A row as a dict of views."""
    return {f.name: to_view(row[f.name], f.dataType) for f in schema}


def to_tensor(value: Any) -> Any:
    """Arrays for tensors, images and lists of numbers; dicts and other values as they are."""
    if isinstance(value, dict):
        return {k: to_tensor(v) for k, v in value.items()}
    if isinstance(value, list):
        inner = [to_tensor(v) for v in value]
        return np.array(inner) if not any(isinstance(v, dict) for v in inner) else inner
    to_numpy = getattr(value, "to_numpy", None)
    if to_numpy is not None:
        out = to_numpy()
        return value.to_dict() if out is None else out
    return value


def plain(value: Any) -> Any:
    """A view as what Spark stores: dicts for semantic values, recursively."""
    if isinstance(value, np.ndarray):
        return NDArray.of(value).to_dict()
    if isinstance(value, (Segment, VideoStream)):
        return dict(vars(value))
    if isinstance(value, YouTubeVideo):
        return {"vid": value.vid}
    if hasattr(value, "to_dict") and not isinstance(value, type):
        return value.to_dict()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value
