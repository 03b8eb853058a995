"""Models run by TensorFlow: a saved model at the spec's URI."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd

from ocellus.sql.models import Detection, ModelType, register_model_type
from ocellus.sql.spec import ModelSpec
from ocellus.types.structs import IMAGE
from ocellus.types.views import to_view


class TensorFlowModel(ModelType):
    def load(self, spec: ModelSpec) -> None:
        try:
            import tensorflow as tf
        except ImportError as e:
            raise ImportError("models of the flavor tensorflow need TensorFlow") from e
        self.spec, self.model = spec, tf.saved_model.load(spec.uri)

    def schema(self) -> str:
        return "array<float>"

    def transform(self, columns: list[pd.Series | pd.DataFrame]) -> list[np.ndarray]:
        frame = columns[0]
        return [to_view(r, IMAGE).to_numpy() for r in frame.to_dict("records")] if isinstance(frame, pd.DataFrame) else [np.asarray(v, np.float32) for v in frame]

    def predict(self, batch: list[np.ndarray]) -> list[Any]:
        return np.asarray(self.model(np.stack(batch))).reshape(len(batch), -1).tolist()


class TensorFlowDetection(TensorFlowModel, Detection):
    schema = Detection.schema

    def predict(self, batch: list[np.ndarray]) -> list[list[dict]]:
        out = [self.model(b[None]) for b in batch]
        raw = [{"boxes": np.asarray(o["detection_boxes"])[0][:, [1, 0, 3, 2]], "scores": np.asarray(o["detection_scores"])[0], "labels": np.asarray(o["detection_classes"])[0].astype(int)} for o in out]
        return Detection.predict(self, raw)


register_model_type("tensorflow", "model", TensorFlowModel)
register_model_type("tensorflow", "ssd", TensorFlowDetection)
