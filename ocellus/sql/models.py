"""Model types: adapters with a schema, a load step, and prediction over numpy batches."""

from __future__ import annotations

import importlib
import importlib.util
import json
import math
from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd

from ocellus.conf import get_option
from ocellus.errors import SpecError
from ocellus.sources.uri import read_bytes
from ocellus.sql.spec import ModelSpec, dotted


class ModelType(ABC):
    """Loaded once in each task; predicts a batch at a time."""

    spec: ModelSpec

    def load(self, spec: ModelSpec) -> None:
        self.spec = spec

    @abstractmethod
    def schema(self) -> str:
        """The default type of a prediction, in the schema language."""

    def transform(self, columns: list[pd.Series | pd.DataFrame]) -> Any:
        """A batch as the model takes it: by default one matrix, arrays side by side."""
        parts = [np.stack([np.asarray(v, np.float64) for v in c]) if len(c) and isinstance(c.iloc[0], (list, tuple, np.ndarray)) else np.asarray(c, np.float64) for c in columns]
        return np.concatenate([p.reshape(len(p), -1) for p in parts], axis=1)

    @abstractmethod
    def predict(self, batch: Any) -> list[Any]:
        """A prediction for each row."""

    def release(self) -> None:
        """Frees what :meth:`load` took."""


class JsonModel(ModelType):
    """A model whose parameters are a JSON document at its URI, or in the option ``parameters``."""

    def load(self, spec: ModelSpec) -> None:
        super().load(spec)
        text = spec.options.get("parameters") or (read_bytes(spec.uri).decode() if spec.uri else None)
        if text is None:
            raise SpecError(f"{spec.name} has neither a uri nor the option parameters")
        self.parameters = json.loads(text)

    def array(self, name: str) -> np.ndarray:
        if name not in self.parameters:
            raise SpecError(f"{self.spec.name} lacks the parameter {name!r}")
        return np.asarray(self.parameters[name], np.float64)


class LinearRegression(JsonModel):
    def schema(self) -> str:
        return "float"

    def predict(self, batch: np.ndarray) -> list[float]:
        return (batch @ self.array("coef") + self.parameters.get("intercept", 0.0)).tolist()


class LogisticRegression(JsonModel):
    def schema(self) -> str:
        return "int"

    def predict(self, batch: np.ndarray) -> list[int]:
        logits = batch @ np.atleast_2d(self.array("coef")).T + self.parameters.get("intercept", 0.0)
        classes = self.parameters.get("classes", list(range(max(2, logits.shape[1]))))
        best = logits.argmax(axis=1) if logits.shape[1] > 1 else (logits[:, 0] > 0).astype(int)
        return [int(classes[i]) for i in best]


class Pca(JsonModel):
    def schema(self) -> str:
        return "array<float>"

    def predict(self, batch: np.ndarray) -> list[list[float]]:
        return ((batch - self.array("mean")) @ self.array("components").T).tolist()


class Forest(JsonModel):
    """Trees as arrays: feature (negative: a leaf), threshold, left, right and value."""

    def leaves(self, batch: np.ndarray) -> np.ndarray:
        out = []
        for tree in self.parameters["trees"]:
            feature, cut = np.array(tree["feature"]), np.array(tree["threshold"], np.float64)
            left, right, value = np.array(tree["left"]), np.array(tree["right"]), np.array(tree["value"], np.float64)
            at = np.zeros(len(batch), np.int64)
            while (inner := feature[at] >= 0).any():
                low = batch[np.arange(len(batch)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            out.append(value[at])
        return np.stack(out)


class ForestRegression(Forest):
    def schema(self) -> str:
        return "float"

    def predict(self, batch: np.ndarray) -> list[float]:
        return self.leaves(batch).mean(axis=0).tolist()


class ForestClassification(Forest):
    def schema(self) -> str:
        return "int"

    def predict(self, batch: np.ndarray) -> list[int]:
        classes = self.parameters.get("classes")
        best = self.leaves(batch).mean(axis=0).argmax(axis=1)
        return [int(classes[i] if classes else i) for i in best]


class Classification(ModelType):
    """Class of each row of logits."""

    def schema(self) -> str:
        return "struct<label_id:int, score:float, label:string>"

    def predict(self, batch: np.ndarray) -> list[dict]:
        shifted = np.exp(batch - batch.max(axis=1, keepdims=True))
        p = shifted / shifted.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        labels = self.spec.labels
        return [{"label_id": int(b), "score": float(p[i, b]), "label": labels[b] if labels and b < len(labels) else None} for i, b in enumerate(best)]


class Detection(ModelType):
    """Raw detections (boxes, scores, labels) with those under ``min_score`` dropped."""

    def schema(self) -> str:
        return "array<struct<box:box2d, score:float, label_id:int, label:string>>"

    def transform(self, columns: list[pd.Series | pd.DataFrame]) -> Any:
        return columns[0]

    def predict(self, batch: Any) -> list[list[dict]]:
        least = float(self.spec.options.get("min_score", 0.5))
        labels = self.spec.labels
        rows = batch.to_dict("records") if isinstance(batch, pd.DataFrame) else batch
        out = []
        for raw in rows:
            found = zip(raw["boxes"], raw["scores"], raw["labels"], strict=True)
            out.append([{"box": dict(zip(("xmin", "ymin", "xmax", "ymax"), map(float, b), strict=True)), "score": float(s), "label_id": int(k), "label": labels[k] if labels and k < len(labels) else None} for b, s, k in found if s >= least])
        return out


class Norm(ModelType):
    """Pretrained model without parameters: the norm of each row; for trying out statements."""

    pretrained = True

    def schema(self) -> str:
        return "double"

    def predict(self, batch: np.ndarray) -> list[float]:
        return [math.sqrt(float((row * row).sum())) for row in batch]


class Pickled(ModelType):
    """An estimator with ``predict`` or ``transform``, pickled at its URI; needs its own library."""

    method, kind = "predict", "float"

    def load(self, spec: ModelSpec) -> None:
        import pickle

        super().load(spec)
        self.model = pickle.loads(read_bytes(spec.uri or ""))

    def schema(self) -> str:
        return self.kind

    def predict(self, batch: np.ndarray) -> list[Any]:
        return np.asarray(getattr(self.model, self.method)(batch)).tolist()


def _pickled(kind: str, method: str = "predict") -> type[Pickled]:
    return type(f"Pickled_{kind}", (Pickled,), {"kind": kind, "method": method})


#: Model types by flavor and name.
MODEL_TYPES: dict[str, dict[str, type[ModelType]]] = {
    "numpy": {
        "linear_regression": LinearRegression, "logistic_regression": LogisticRegression, "pca": Pca, "random_forest_regression": ForestRegression, "random_forest_classification": ForestClassification,
        "classification": Classification, "detection": Detection, "norm": Norm,
    },
    "sklearn": {"linear_regression": _pickled("float"), "logistic_regression": _pickled("int"), "random_forest_regression": _pickled("float"), "random_forest_classification": _pickled("int"), "pca": _pickled("array<float>", "transform")},
}


def register_model_type(flavor: str, name: str, kind: type[ModelType]) -> None:
    MODEL_TYPES.setdefault(flavor, {})[name] = kind


def model_type_of(spec: ModelSpec) -> ModelType:
    """The adapter of a spec: a dotted path (a class, or a module with MODEL_TYPE), or a name of its flavor."""
    flavor, name = spec.flavor or "numpy", spec.model_type
    if not name:
        raise SpecError(f"{spec.name} has no model type")
    if flavor not in MODEL_TYPES and importlib.util.find_spec(f"ocellus.contrib.{flavor}"):
        importlib.import_module(f"ocellus.contrib.{flavor}")  # registers its types
    if name in MODEL_TYPES.get(flavor, {}):
        return MODEL_TYPES[flavor][name]()
    for path in ([name] if "." in name else [f"ocellus.contrib.{flavor}.{name}"]):
        try:
            module = importlib.import_module(path)
        except ImportError:
            continue
        if hasattr(module, "MODEL_TYPE"):
            found = module.MODEL_TYPE
            return found() if isinstance(found, type) else found
    if "." in name:
        found = dotted(name)
        return found() if isinstance(found, type) else found
    raise SpecError(f"flavor {flavor!r} has no model type {name!r}")


def run(spec: ModelSpec, model: ModelType, batches: Iterator[list[Any]]) -> Iterator[list[Any]]:
    """Predictions of batches of columns; the model is loaded once and released at the end.

    Rows in which a column is null have a null prediction.
    """
    size = int(spec.options.get("batch_size", get_option("predict.batch_size"))) if "batch_size" in spec.options else None
    model.load(spec)
    try:
        for columns in batches:
            n = len(columns[0])
            null = np.zeros(n, bool)
            for c in columns:
                null |= (c.isna().all(axis=1) if isinstance(c, pd.DataFrame) else c.isna()).to_numpy()
            full = np.flatnonzero(~null)
            out: list[Any] = [None] * n
            for first in range(0, len(full), size or max(1, len(full))):
                rows = full[first : first + (size or len(full))]
                for i, value in zip(rows, model.predict(model.transform([c.iloc[rows] for c in columns])), strict=True):
                    out[i] = value
            yield out
    finally:
        model.release()


def apply_spec(spec: ModelSpec, batches: Iterator[list[Any]]) -> Iterator[list[Any]]:
    """Runs a spec's model without Spark, for tests."""
    return run(spec, model_type_of(spec), batches)
