"""Tensors as struct values: dtype, shape and row-major bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class NDArray:
    dtype: str
    shape: tuple[int, ...]
    data: bytes

    @classmethod
    def of(cls, values) -> NDArray:
        a = np.ascontiguousarray(values)
        return cls(str(a.dtype), a.shape, a.tobytes())

    @classmethod
    def empty(cls, shape: tuple[int, ...], dtype: str = "float64") -> NDArray:
        return cls.of(np.zeros(shape, dtype))

    def to_numpy(self) -> np.ndarray:
        return np.frombuffer(self.data, dtype=self.dtype).reshape(tuple(self.shape))

    def to_dict(self) -> dict:
        return {"dtype": self.dtype, "shape": list(self.shape), "data": self.data}
