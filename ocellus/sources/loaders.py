"""Adapters to training frameworks; each needs its framework only when used."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ocellus.conf import DEFAULTS, get_option
from ocellus.sources.dataset import Dataset, write_dataset
from ocellus.types.views import to_tensor, to_view


def cached(data: DataFrame | str) -> str:
    """The URI of a dataset; a DataFrame is written below the option ``cache_uri`` first.

    Without that option the session's shared folder is used, where it has one.
    """
    if isinstance(data, str):
        return data
    base = str(get_option("cache_uri"))
    if base == DEFAULTS["cache_uri"]:
        base = data.sparkSession.conf.get("spark.checkpoint.dir", None) or base
    uri = f"{base.rstrip('/')}/{uuid.uuid4()}"
    write_dataset(data, uri)
    return uri


def tensors(data: DataFrame | str, columns: list[str] | None = None, offset: int = 0, rank: int = 0, world_size: int = 1, transform: Callable[[dict], Any] | None = None) -> Iterator[Any]:
    """Rows as dicts of arrays."""
    for row in Dataset(cached(data), columns, offset, rank, world_size):
        made = {k: to_tensor(v) for k, v in row.items()}
        yield transform(made) if transform else made


def torch_dataset(data: DataFrame | str, columns: list[str] | None = None, offset: int = 0, transform: Callable[[dict], Any] | None = None):
    """An iterable dataset; each loader worker reads its share of the row groups."""
    try:
        from torch.utils.data import IterableDataset, get_worker_info
    except ImportError as e:
        raise ImportError("torch_dataset needs PyTorch") from e
    uri = cached(data)

    class Rows(IterableDataset):
        def __iter__(self):
            info = get_worker_info()
            rank, world = (info.id, info.num_workers) if info else (0, 1)
            return tensors(uri, columns, offset, rank, world, transform)

    return Rows()


def image_dataset(data: DataFrame | str, image: str, targets: list[str], transform: Callable | None = None, target_transform: Callable | None = None) -> Iterator[tuple[Any, Any]]:
    """Pairs of an image's pixels and its target, or dict of targets."""
    for row in tensors(data, [image, *targets]):
        target = row[targets[0]] if len(targets) == 1 else {t: row[t] for t in targets}
        yield (transform(row[image]) if transform else row[image], target_transform(target) if target_transform else target)


def tf_dataset(data: DataFrame | str, output_signature: Any, columns: list[str] | None = None):
    """A TensorFlow dataset of the rows' columns."""
    try:
        import tensorflow as tf
    except ImportError as e:
        raise ImportError("tf_dataset needs TensorFlow") from e
    uri = cached(data)
    return tf.data.Dataset.from_generator(lambda: (tuple(r.values()) for r in tensors(uri, columns)), output_signature=output_signature)


class FrameDataset:
    """A map-style dataset over a pandas column or frame, as used inside a vectorised UDF."""

    def __init__(self, frame: pd.Series | pd.DataFrame, schema: Any = None, transform: Callable | None = None):
        self.frame, self.schema, self.transform = frame, schema, transform

    def __len__(self) -> int:
        return len(self.frame)

    def __getitem__(self, i: int) -> Any:
        value = self.frame.iloc[i]
        value = value.to_dict() if isinstance(value, pd.Series) else value
        made = to_tensor(to_view(value, self.schema) if self.schema is not None else value)
        return self.transform(made) if self.transform else made

    def batches(self, size: int) -> Iterator[np.ndarray | list]:
        for first in range(0, len(self), size):
            rows = [self[i] for i in range(first, min(first + size, len(self)))]
            yield np.stack(rows) if all(isinstance(r, np.ndarray) and r.shape == rows[0].shape for r in rows) else rows
