"""Drawing of images with boxes, masks and text as SVG, for notebooks."""

from __future__ import annotations

import base64
from dataclasses import dataclass, field, replace
from html import escape

from ocellus.conf import get_option
from ocellus.types import Box2d, Image, Mask, png
from ocellus.types.structs import POLYGON


@dataclass(frozen=True)
class Style:
    """How something is drawn; ``box @ Style(color="blue")``."""

    color: str | None = None
    width: float = 1.0
    fill: bool = False
    text: str | None = None

    @property
    def paint(self) -> str:
        return self.color or str(get_option("viz.color"))

    def __rmatmul__(self, thing) -> Drawn:
        return Drawn(thing, self)


@dataclass(frozen=True)
class Drawn:
    thing: Box2d | Mask | str
    style: Style = field(default_factory=Style)

    def svg(self) -> str:
        s = self.style
        look = f'stroke="{escape(s.paint)}" stroke-width="{s.width}" fill="{escape(s.paint) if s.fill else "none"}" fill-opacity="0.4"'
        label = lambda x, y: f'<text x="{x}" y="{y}" fill="{escape(s.paint)}" font-size="12">{escape(s.text)}</text>' if s.text else ""
        if isinstance(self.thing, Box2d):
            b = self.thing
            return f'<rect x="{b.xmin}" y="{b.ymin}" width="{b.width}" height="{b.height}" {look}/>' + label(b.xmin, max(12, b.ymin - 2))
        if isinstance(self.thing, Mask):
            if self.thing.type == POLYGON:
                return "".join('<polygon points="' + " ".join(f"{p[i]},{p[i + 1]}" for i in range(0, len(p), 2)) + f'" {look}/>' for p in self.thing.polygon or [])
            import numpy as np

            m = self.thing.to_mask()
            pixels = np.stack([m * 255, m * 0, m * 0, m * 110], axis=2).astype(np.uint8)
            return f'<image href="data:image/png;base64,{base64.b64encode(png.encode(pixels)).decode()}" width="{self.thing.width}" height="{self.thing.height}"/>'
        return f'<text x="4" y="14" fill="{escape(s.paint)}" font-size="12">{escape(str(self.thing))}</text>'


def with_label(box: Box2d, text: str, color: str | None = None) -> Drawn:
    return Drawn(box, Style(color=color, text=text))


@dataclass(frozen=True)
class Draw:
    """An image and what is drawn on it: ``Draw(image) | box | mask @ style``."""

    image: Image
    parts: tuple[Drawn, ...] = ()

    def __or__(self, part) -> Draw:
        many = part if isinstance(part, (list, tuple)) and not isinstance(part, Box2d) else [part]
        return replace(self, parts=(*self.parts, *(p if isinstance(p, Drawn) else Drawn(p) for p in many)))

    def to_svg(self) -> str:
        data = self.image.read()
        h, w = self.image.to_numpy().shape[:2]
        kind = "png" if data.startswith(png.MAGIC) else "jpeg"
        shown = f'<image href="data:image/{kind};base64,{base64.b64encode(data).decode()}" width="{w}" height="{h}"/>'
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}">{shown}{"".join(p.svg() for p in self.parts)}</svg>'

    _repr_html_ = to_svg
