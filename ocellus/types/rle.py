"""Run-length encoding of binary masks: counts alternate, zeros first."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def encode(mask: np.ndarray | Sequence) -> list[int]:
    """Run lengths of a mask in row-major order; a leading 0 if it begins with a one; empty for an empty mask."""
    bits = np.asarray(mask).reshape(-1).astype(bool)
    if not bits.size:
        return []
    edges = np.flatnonzero(bits[1:] != bits[:-1]) + 1
    runs = np.diff(np.concatenate([[0], edges, [bits.size]])).tolist()
    return [0, *runs] if bits[0] else runs


def decode(counts: Sequence[int], shape: tuple[int, ...], order: str = "C") -> np.ndarray:
    """The mask of a shape whose values in ``order`` have these run lengths."""
    values = np.repeat(np.arange(len(counts)) % 2, counts).astype(np.uint8)
    if values.size != int(np.prod(shape)):
        raise ValueError(f"the runs have {values.size} values, the shape {shape} needs {int(np.prod(shape))}")
    return values.reshape(shape, order="F" if order.upper() == "F" else "C")
