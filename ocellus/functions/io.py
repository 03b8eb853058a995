"""Functions that touch files; each runs once for a row."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocellus.operators.frames import METADATA, sampled_frames
from ocellus.types.structs import IMAGE


@F.udf(T.StringType())
def _copy(source, target):
    from ocellus.sources.uri import copy as copy_file

    return None if source is None or target is None else copy_file(source, target)


#: ``copy(source, target)``: copies a file, and returns the copy's URI.
copy = _copy.asNondeterministic()


@F.udf(IMAGE)
def _image_copy(image, target):
    from ocellus.sources.uri import copy as copy_file
    from ocellus.sources.uri import write_bytes

    if image is None or target is None:
        return None
    if image["data"] is not None:
        write_bytes(target, bytes(image["data"]))
        return {"data": None, "uri": target}
    return {"data": None, "uri": copy_file(image["uri"], target)}


#: ``image_copy(image, target)``: stores an image, and returns it by its new URI.
image_copy = _image_copy.asNondeterministic()


@F.udf(IMAGE)
def _numpy_to_image(array, uri, format):
    import numpy as np

    from ocellus.types import Image

    if array is None:
        return None
    pixels = np.frombuffer(bytes(array["data"]), array["dtype"]).reshape(tuple(array["shape"]))
    return Image.from_array(pixels, uri, format or "PNG").to_dict()


#: ``numpy_to_image(ndarray, uri, format)``: encodes pixels and stores or (null uri) embeds them.
numpy_to_image = _numpy_to_image.asNondeterministic()


@F.udf(T.ArrayType(IMAGE))
def crop(image, boxes):
    """An embedded image for each box."""
    from ocellus.types import Box2d, Image

    if image is None or boxes is None:
        return None
    view = Image(data=bytes(image["data"]) if image["data"] is not None else None, uri=image["uri"])
    return [i.to_dict() for i in view.crop([Box2d(b["xmin"], b["ymin"], b["xmax"], b["ymax"]) for b in boxes])]


def image(uri: Column) -> Column:
    """An image by URI; null for null."""
    return F.when(uri.isNotNull(), F.struct(F.lit(None).cast("binary").alias("data"), uri.alias("uri")))


def image_of_bytes(data: Column) -> Column:
    """An embedded image; null for null."""
    return F.when(data.isNotNull(), F.struct(data.alias("data"), F.lit(None).cast("string").alias("uri")))


def _run(*command: str) -> tuple[str, str]:
    done = subprocess.run(command, capture_output=True, timeout=300)
    if done.returncode:
        raise RuntimeError(done.stderr.decode(errors="replace"))
    return done.stdout.decode(), done.stderr.decode(errors="replace")


@F.udf(T.StructType([T.StructField(n, T.StringType()) for n in ("probe", "stderr", "message")]))
def probe(uri):
    """A prober's JSON for a video; what goes wrong is returned."""
    if uri is None:
        return None
    try:
        out, err = _run("ffprobe", "-v", "error", "-print_format", "json", "-show_format", "-show_streams", uri.removeprefix("file://"))
        return {"probe": out, "stderr": err, "message": None}
    except FileNotFoundError:
        return {"probe": None, "stderr": None, "message": "ffprobe error: ffprobe is not installed"}
    except Exception as e:
        return {"probe": None, "stderr": str(e), "message": f"ffprobe error: {e}"}


def video_metadata(uri: Column) -> Column:
    """Metadata of a video file; failures are rows with ``_errors``."""
    from ocellus.operators.frames import metadata_of_probe

    p = probe(uri)
    failed = F.struct(p["message"].alias("message"), p["stderr"].alias("stderr"), p["probe"].alias("probe"))
    names = ["width", "height", "num_frames", "duration", "bit_rate", "frame_rate", "codec", "size"]
    nothing = F.struct(*[F.lit(None).alias(n) for n in names], failed.alias("_errors")).cast(METADATA)
    return F.when(p["probe"].isNotNull(), metadata_of_probe(p["probe"]).cast(METADATA)).when(uri.isNotNull(), nothing)


@F.udf(T.ArrayType(IMAGE))
def _frames_to_images(video, frames, uri, quality, format):
    """Decodes frames with OpenCV, where that is installed, and stores each as ``uri/<frame>.<format>``."""
    try:
        import cv2
    except ImportError as e:
        raise ImportError("decoding videos needs OpenCV") from e
    from ocellus.sources.uri import write_bytes

    if video is None or frames is None:
        return None
    reader, out = cv2.VideoCapture(video["uri"]), []
    try:
        for n in frames:
            reader.set(cv2.CAP_PROP_POS_FRAMES, n)
            good, pixels = reader.read()
            if not good:
                break
            data = cv2.imencode(f".{format}", pixels, [cv2.IMWRITE_JPEG_QUALITY, quality])[1].tobytes()
            if uri is None:
                out.append({"data": data, "uri": None})
            else:
                write_bytes(f"{uri.rstrip('/')}/{n}.{format}", data)
                out.append({"data": None, "uri": f"{uri.rstrip('/')}/{n}.{format}"})
    finally:
        reader.release()
    return out


def video_to_images(video: Column, uri: Column, segment: Column, n_frames: Column, rate: int = 1, most: int = 15000, quality: int = 75, format: str = "jpg") -> Column:
    """Images of one of every ``rate`` frames of a segment, named by their real frame number."""
    return _frames_to_images(video, sampled_frames(segment, n_frames, rate, most), uri, F.lit(quality), F.lit(format))


@F.udf(IMAGE)
def _spectrogram(video, uri, start, length, size, format):
    import tempfile
    from pathlib import Path

    from ocellus.types import Image

    if video is None:
        return None
    with tempfile.TemporaryDirectory() as d:
        out = Path(d) / f"s.{format}"
        _run("ffmpeg", "-v", "error", "-ss", str(start or 0), *(["-t", str(length)] if length else []), "-i", video["uri"], "-lavfi", f"showspectrumpic=s={size}x{size}:legend=disabled", str(out))
        made = Image(data=out.read_bytes())
        return (made if uri is None else made.save(uri)).to_dict()


#: ``spectrogram_image(video, uri, start, length, size, format)``: needs ffmpeg.
spectrogram_image = _spectrogram.asNondeterministic()


def parse_probe(text: str) -> dict:
    """A prober's JSON as a dict, for looking at single files."""
    return json.loads(text)
