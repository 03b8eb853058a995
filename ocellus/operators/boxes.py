"""Box geometry as Column expressions; all stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ocellus.types.structs import BOX2D

NAMES = ("xmin", "ymin", "xmax", "ymax")


def _both(a: Column, b: Column, value: Column) -> Column:
    """``value`` where neither box is null (greatest and least would skip nulls)."""
    return F.when(a.isNotNull() & b.isNotNull(), value)


def _box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((xmin, ymin, xmax, ymax), NAMES, strict=True)])


def width(box: Column) -> Column:
    return box["xmax"] - box["xmin"]


def height(box: Column) -> Column:
    return box["ymax"] - box["ymin"]


def area(box: Column) -> Column:
    """Height times width; null for a null box."""
    return height(box) * width(box)


def _common(a: Column, b: Column) -> Column:
    w = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    h = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def intersection_area(a: Column, b: Column) -> Column:
    """Area in both boxes; 0 where they only touch."""
    return _both(a, b, _common(a, b))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; NaN for two boxes without area, null if one is null."""
    common = _common(a, b)
    union = area(a) + area(b) - common
    return _both(a, b, F.when(union == 0, F.lit(float("nan"))).otherwise(common / union))


def intersect(a: Column, b: Column) -> Column:
    """The common box; null where boxes only touch or are apart."""
    corners = F.greatest(a["xmin"], b["xmin"]), F.greatest(a["ymin"], b["ymin"]), F.least(a["xmax"], b["xmax"]), F.least(a["ymax"], b["ymax"])
    return _both(a, b, F.when((corners[0] < corners[2]) & (corners[1] < corners[3]), _box(*corners)))


def overlaps(a: Column, b: Column) -> Column:
    return _both(a, b, intersect(a, b).isNotNull())


def scale(box: Column, x: Column | float, y: Column | float | None = None) -> Column:
    """The box with its coordinates multiplied by positive factors."""
    x, y = (F.lit(v) if isinstance(v, (int, float)) else v for v in (x, x if y is None else y))
    scaled = _box(box["xmin"] * x, box["ymin"] * y, box["xmax"] * x, box["ymax"] * y)
    return F.when(box.isNotNull(), F.when((x > 0) & (y > 0), scaled).otherwise(F.raise_error(F.lit("scale factors must be positive"))))


def shrink(box: Column, x: Column | float, y: Column | float | None = None) -> Column:
    """The box with its coordinates divided by positive factors, as in bringing pixels to the unit square."""
    x, y = (F.lit(v) if isinstance(v, (int, float)) else v for v in (x, x if y is None else y))
    shrunk = _box(box["xmin"] / x, box["ymin"] / y, box["xmax"] / x, box["ymax"] / y)
    return F.when(box.isNotNull(), F.when((x > 0) & (y > 0), shrunk).otherwise(F.raise_error(F.lit("scale factors must be positive"))))


def iou_list(box: Column, boxes: Column) -> Column:
    """IOU with each box of an array; empty for an empty array."""
    return F.when(box.isNotNull(), F.transform(boxes, lambda b: iou(box, b)))


def iou_matrix(some: Column, others: Column) -> Column:
    """IOU of each box of one array with each of another; null if one is empty."""
    return F.when((F.size(some) > 0) & (F.size(others) > 0), F.transform(some, lambda a: F.transform(others, lambda b: iou(a, b))))


def to_array(box: Column) -> Column:
    return F.when(box.isNotNull(), F.array(*[box[n] for n in NAMES]))


def _checked(values: Column, box: Column, sizes: Column | None = None) -> Column:
    """``box`` if the four values make one, else an error; null for null."""
    right = (box["xmin"] >= 0) & (box["xmin"] <= box["xmax"]) & (box["ymin"] >= 0) & (box["ymin"] <= box["ymax"])
    if sizes is not None:
        right = right & sizes
    message = F.concat(F.lit("not a box: "), F.to_json(F.struct(values.alias("values"))))
    return F.when(values.isNotNull(), F.when((F.size(values) == 4) & right, box).otherwise(F.raise_error(message).cast(BOX2D)))


def box2d(values: Column) -> Column:
    """Box of [xmin, ymin, xmax, ymax]."""
    v = [F.get(values, F.lit(i)) for i in range(4)]
    return _checked(values, _box(*v))


def box2d_from_center(values: Column) -> Column:
    """Box of [x, y, width, height] around its centre; one that reaches below 0 is an error."""
    x, y, w, h = (F.get(values, F.lit(i)) for i in range(4))
    return _checked(values, _box(x - w / 2, y - h / 2, x + w / 2, y + h / 2), (w >= 0) & (h >= 0))


def box2d_from_top_left(values: Column) -> Column:
    """Box of [left, top, width, height]."""
    x, y, w, h = (F.get(values, F.lit(i)) for i in range(4))
    return _checked(values, _box(x, y, x + w, y + h), (w >= 0) & (h >= 0))


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def box3d(center: Column, length: Column, width_: Column, height_: Column, heading: Column) -> Column:
    rest = zip((length, width_, height_, heading), ("length", "width", "height", "heading"), strict=True)
    return F.struct(center.alias("center"), *[c.cast("double").alias(n) for c, n in rest])


def near(a: Column, b: Column, names: tuple[str, ...] = NAMES, tolerance: float = 1e-8) -> Column:
    """Whether all fields of two structs agree within a tolerance."""
    out = F.lit(True)
    for n in names:
        out = out & (F.abs(a[n] - b[n]) < tolerance)
    return out
