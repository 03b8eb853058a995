"""What follows a model's raw outputs: softmax, classification, score filters, suppression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DETECTIONS = "array<struct<box:struct<xmin:double,ymin:double,xmax:double,ymax:double>,score:float,label_id:int,label:string>>"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits; the largest is taken off first."""
    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(p, lambda x: x / total)))


def classify(logits: Column, labels: Column | None = None) -> Column:
    """struct(label_id, score, label): the most probable class; of ties the first."""
    ids = lambda p: F.array_position(p, F.array_max(p)).cast("int") - 1
    label = (lambda p: F.get(labels, ids(p))) if labels is not None else (lambda p: F.lit(None).cast("string"))
    return let(softmax(logits), lambda p: F.struct(ids(p).alias("label_id"), F.array_max(p).cast("float").alias("score"), label(p).alias("label")))


def keep_scores(detections: Column, least: Column | float = 0.5) -> Column:
    """Detections whose score is ``least`` or more."""
    least = F.lit(float(least)) if isinstance(least, (int, float)) else least
    return F.filter(detections, lambda d: d["score"] >= least)


def top_scores(scores: Column, k: int, least: float = 0.0) -> Column:
    """The ``k`` highest of an array of scores as structs (score, label_id), best first; of ties the lower id."""
    placed = F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.cast("int").alias("label_id")))
    best = F.slice(F.array_sort(placed), 1, k)
    return F.filter(F.transform(best, lambda x: F.struct((-x["neg"]).alias("score"), x["label_id"].alias("label_id"))), lambda x: x["score"] >= least)


def suppressed(boxes: np.ndarray, scores: np.ndarray, labels: np.ndarray, most_common: float) -> np.ndarray:
    """Rows that non-maximum suppression keeps, label by label, best scores first."""
    order = np.argsort(-scores, kind="stable")
    kept: list[int] = []
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    alive = np.ones(len(order), bool)
    for i in order:
        if not alive[i]:
            continue
        kept.append(int(i))
        corner = np.maximum(np.minimum(boxes[:, 2:], boxes[i, 2:]) - np.maximum(boxes[:, :2], boxes[i, :2]), 0)
        common = corner[:, 0] * corner[:, 1]
        with np.errstate(invalid="ignore", divide="ignore"):
            alive &= ~((labels == labels[i]) & (common / (area + area[i] - common) > most_common))
        alive[i] = False
    return np.array(kept, np.int64)


def suppressed_groups(groups: np.ndarray, boxes: np.ndarray, scores: np.ndarray, labels: np.ndarray, most_common: float) -> np.ndarray:
    """Rows that :func:`suppressed` keeps of each group, by group and best scores first; all groups at once.

    In each round every group's best remaining row is kept and those it covers leave.
    """
    order = np.lexsort((-scores, groups))
    g, box, label = groups[order], boxes[order], labels[order]
    area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    kept, alive = [np.zeros(0, np.int64)], np.arange(len(order))
    while len(alive):
        first = np.concatenate([[True], g[alive[1:]] != g[alive[:-1]]])
        best = alive[first]
        kept.append(best)
        by = best[np.cumsum(first) - 1]
        corner = np.maximum(np.minimum(box[alive, 2:], box[by, 2:]) - np.maximum(box[alive, :2], box[by, :2]), 0)
        common = corner[:, 0] * corner[:, 1]
        with np.errstate(invalid="ignore", divide="ignore"):
            covered = (label[alive] == label[by]) & (common / (area[alive] + area[by] - common) > most_common)
        alive = alive[~(covered | first)]
    return order[np.sort(np.concatenate(kept))]


#: Fixed value: stands for a null label, which is no 32-bit label.
_NO_LABEL = 2**40


def non_maximum_suppression(detections: Column, most_common: float = 0.5, most: int | None = None) -> Column:
    """Detections that no better one of the same label covers by over ``most_common`` (IOU), best first; all, or the ``most`` best of them.

    A null score comes last; null labels are one label.
    """

    @F.arrow_udf(DETECTIONS)
    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
            found = batch.flatten()
            number = lambda *path: pc.fill_null(pc.cast(pc.struct_field(found, list(path)), pa.float64()), np.nan).to_numpy(zero_copy_only=False)
            boxes = np.stack([number("box", n) for n in ("xmin", "ymin", "xmax", "ymax")], axis=1)
            labels = pc.fill_null(pc.cast(pc.struct_field(found, ["label_id"]), pa.int64()), _NO_LABEL).to_numpy(zero_copy_only=False)
            groups = np.repeat(np.arange(len(batch)), sizes)
            rows = suppressed_groups(groups, boxes, number("score"), labels, most_common)
            if most is not None:
                of = groups[rows]
                rows = rows[np.arange(len(rows)) - np.searchsorted(of, of) < most]
            ends = np.concatenate([[0], np.cumsum(np.bincount(groups[rows], minlength=len(batch)))])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.take(pa.array(rows)), type=batch.type, mask=batch.is_null())

    return keep(detections.cast(DETECTIONS))


def class_scores(boxes: np.ndarray, logits: np.ndarray, *, threshold: float, candidates: int, most_common: float, detections: int, classes: int, least: float) -> list[dict]:
    """Boxes of a single-shot detector with each box's best classes; class 0 is background.

    Every other class keeps its ``candidates`` best boxes over ``threshold``;
    suppression runs within classes; the ``detections`` best boxes remain, with
    their ``classes`` best classes.  A box whose best score is under ``least``
    is dropped.
    """
    shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
    p = shifted / shifted.sum(axis=1, keepdims=True)
    rows, labels = [], []
    for c in range(1, p.shape[1]):
        over = np.flatnonzero(p[:, c] > threshold)
        best = over[np.argsort(-p[over, c], kind="stable")[:candidates]]
        rows.append(best)
        labels.append(np.full(len(best), c))
    row, label = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, labels))
    kept = suppressed(boxes[row], p[row, label], label, most_common)[:detections]
    out = []
    for i in row[kept]:
        best = np.argsort(-p[i, 1:], kind="stable")[:classes] + 1
        if p[i, best[0]] >= least:
            out.append({"box": dict(zip(("xmin", "ymin", "xmax", "ymax"), boxes[i].tolist(), strict=True)), "label_ids": best.tolist(), "scores": p[i, best].tolist()})
    return out
