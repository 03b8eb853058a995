"""Semantic types: Spark structs and Python views of their values."""

from ocellus.types.geometry import Box2d, Box3d, Mask, Point
from ocellus.types.structs import BOX2D, BOX3D, IMAGE, MASK, NAMED_TYPES, NDARRAY, POINT, SEGMENT, VIDEO_STREAM, YOUTUBE_VIDEO
from ocellus.types.tensor import NDArray
from ocellus.types.video import Segment, VideoStream, YouTubeVideo
from ocellus.types.views import to_view, view_of
from ocellus.types.vision import Image

__all__ = ["BOX2D", "BOX3D", "IMAGE", "MASK", "NAMED_TYPES", "NDARRAY", "POINT", "SEGMENT", "VIDEO_STREAM", "YOUTUBE_VIDEO", "Box2d", "Box3d", "Image", "Mask", "NDArray", "Point", "Segment", "VideoStream", "YouTubeVideo", "to_view", "view_of"]
