"""Images: embedded bytes or the URI of a file."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ocellus.types import png
from ocellus.types.geometry import Box2d


@dataclass(frozen=True, eq=False)
class Image:
    """Exactly one of ``data`` and ``uri`` is set."""

    data: bytes | None = None
    uri: str | None = None

    def __post_init__(self) -> None:
        if (self.data is None) == (self.uri is None):
            raise ValueError("an image has either data or a uri")

    def __eq__(self, other: object) -> bool:
        from ocellus.sources.uri import same_uri

        if not isinstance(other, Image):
            return NotImplemented
        if self.uri is not None and other.uri is not None:
            return same_uri(self.uri, other.uri)
        return self.uri == other.uri and self.data == other.data

    def __hash__(self) -> int:
        return hash((self.data, self.uri and self.uri.removeprefix("file://")))

    @property
    def is_embedded(self) -> bool:
        return self.data is not None

    @classmethod
    def from_array(cls, pixels: np.ndarray, uri: str | None = None, format: str = "PNG") -> Image:
        """Encodes pixels and stores them at ``uri``, or embeds them."""
        if format.upper() == "PNG":
            data = png.encode(pixels)
        else:
            data = _with_pillow(pixels, format)
        if uri is None:
            return cls(data=data)
        from ocellus.sources.uri import write_bytes

        write_bytes(uri, data)
        return cls(uri=uri)

    def read(self) -> bytes:
        from ocellus.sources.uri import read_bytes

        return self.data if self.data is not None else read_bytes(self.uri or "")

    def to_embedded(self) -> Image:
        return Image(data=self.read())

    def to_numpy(self) -> np.ndarray:
        data = self.read()
        if data.startswith(png.MAGIC):
            return png.decode(data)
        return np.asarray(_pillow().open(__import__("io").BytesIO(data)))

    def save(self, uri: str) -> Image:
        from ocellus.sources.uri import write_bytes

        write_bytes(uri, self.read())
        return Image(uri=uri)

    def crop(self, boxes: Box2d | list[Box2d], uris: list[str] | None = None, format: str = "PNG") -> list[Image]:
        """An image for each box, cut at whole pixels."""
        pixels = self.to_numpy()
        every = [boxes] if isinstance(boxes, Box2d) else list(boxes)
        if uris is not None and len(uris) != len(every):
            raise ValueError("each box needs a uri")
        return [Image.from_array(pixels[int(b.ymin) : int(b.ymax), int(b.xmin) : int(b.xmax)], uris[i] if uris else None, format) for i, b in enumerate(every)]

    def scale(self, by: float | tuple[float, float]) -> Image:
        """The image with its width and height multiplied and truncated; nearest pixels."""
        x, y = (by, by) if isinstance(by, (int, float)) else by
        pixels = self.to_numpy()
        h, w = int(pixels.shape[0] * y), int(pixels.shape[1] * x)
        rows, columns = (np.arange(h) / y).astype(int), (np.arange(w) / x).astype(int)
        return Image.from_array(pixels[rows][:, columns])

    __mul__ = scale

    def to_dict(self) -> dict:
        return {"data": self.data, "uri": self.uri}


def _pillow():
    try:
        from PIL import Image as Pillow
    except ImportError as e:
        raise ImportError("images other than PNG need Pillow") from e
    return Pillow


def _with_pillow(pixels: np.ndarray, format: str) -> bytes:
    import io

    out = io.BytesIO()
    _pillow().fromarray(pixels).save(out, format=format)
    return out.getvalue()
