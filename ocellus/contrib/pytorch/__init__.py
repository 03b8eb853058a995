"""Models run by PyTorch; each is loaded once for each task and released at its end."""

from __future__ import annotations

import io
import os
from typing import Any

import numpy as np
import pandas as pd

from ocellus.errors import SpecError
from ocellus.operators.detections import class_scores
from ocellus.sources.uri import read_bytes
from ocellus.sql.models import Classification, Detection, ModelType, register_model_type
from ocellus.sql.spec import ModelSpec
from ocellus.types.structs import IMAGE
from ocellus.types.views import to_view

#: Networks by name, as torchvision calls them, and their tasks.
CLASSIFIERS = [f"resnet{n}" for n in (18, 34, 50, 101, 152)] + [f"efficientnet_b{n}" for n in range(8)] + [f"convnext_{s}" for s in ("tiny", "small", "base", "large")]
DETECTORS = ["fasterrcnn_resnet50_fpn", "fasterrcnn_mobilenet_v3_large_fpn", "fasterrcnn_mobilenet_v3_large_320_fpn", "maskrcnn_resnet50_fpn", "retinanet_resnet50_fpn", "ssd300_vgg16", "ssdlite320_mobilenet_v3_large", "keypointrcnn_resnet50_fpn"]


def _torch():
    try:
        import torch
    except ImportError as e:
        raise ImportError("models of the flavor pytorch need PyTorch") from e
    return torch


class TorchModel(ModelType):
    """A network in evaluation mode.  Options: device, num_threads, batch_size."""

    network: str | None = None
    pretrained = True

    def load(self, spec: ModelSpec) -> None:
        torch = _torch()
        self.spec = spec
        self.device = spec.options.get("device", "cuda" if torch.cuda.is_available() else "cpu")
        torch.set_num_threads(int(spec.options.get("num_threads", min(os.cpu_count() or 1, 8))))
        if spec.uri:
            self.model = torch.load(io.BytesIO(read_bytes(spec.uri)), map_location=self.device, weights_only=False)
        elif self.network:
            import torchvision

            self.model = torchvision.models.get_model(self.network, weights="DEFAULT")
        else:
            raise SpecError(f"{spec.name} has neither a uri nor a network")
        self.model.eval().to(self.device)

    def release(self) -> None:
        if getattr(self, "device", "cpu") != "cpu":
            self.model.cpu()
            _torch().cuda.empty_cache()

    def transform(self, columns: list[pd.Series | pd.DataFrame]) -> list[np.ndarray]:
        frame = columns[0]
        if isinstance(frame, pd.DataFrame):
            return [to_view(r, IMAGE).to_numpy() for r in frame.to_dict("records")]
        return [np.asarray(v, np.float32) for v in frame]

    def tensors(self, batch: list[np.ndarray]) -> list[Any]:
        torch = _torch()
        scale = lambda a: a.transpose(2, 0, 1) / 255 if a.ndim == 3 else a
        return [torch.as_tensor(scale(np.asarray(a, np.float32)), dtype=torch.float32, device=self.device) for a in batch]

    def outputs(self, batch: list[np.ndarray]) -> Any:
        torch = _torch()
        with torch.no_grad():
            return self.model(torch.stack(self.tensors(batch)))

    def schema(self) -> str:
        return "array<float>"

    def predict(self, batch: list[np.ndarray]) -> list[Any]:
        return self.outputs(batch).reshape(len(batch), -1).cpu().numpy().tolist()


class TorchClassification(TorchModel, Classification):
    schema = Classification.schema

    def predict(self, batch: list[np.ndarray]) -> list[dict]:
        return Classification.predict(self, self.outputs(batch).cpu().numpy())


class TorchDetection(TorchModel, Detection):
    schema = Detection.schema

    def predict(self, batch: list[np.ndarray]) -> list[list[dict]]:
        torch = _torch()
        with torch.no_grad():
            found = self.model(self.tensors(batch))
        raw = [{k: d[k].cpu().numpy() for k in ("boxes", "scores", "labels")} for d in found]
        return Detection.predict(self, raw)


class ClassScores(TorchModel):
    """Boxes of a single-shot detector with each box's best classes."""

    def schema(self) -> str:
        return "array<struct<box:box2d, label_ids:array<int>, scores:array<double>>>"

    def predict(self, batch: list[np.ndarray]) -> list[list[dict]]:
        o = self.spec.options
        boxes, logits = self.outputs(batch)
        return [class_scores(b.cpu().numpy(), s.cpu().numpy(), threshold=float(o.get("score_thresh", 0.01)), candidates=int(o.get("topk_candidates", 400)), most_common=float(o.get("nms_thresh", 0.45)), detections=int(o.get("detections_per_img", 200)), classes=int(o.get("topk", 2)), least=float(o.get("min_score", 0.3))) for b, s in zip(boxes, logits, strict=True)]


class FeatureExtractor(TorchModel):
    """The output of a named node of the network (option ``node``) as an embedding."""

    def load(self, spec: ModelSpec) -> None:
        super().load(spec)
        from torchvision.models.feature_extraction import create_feature_extractor

        self.model = create_feature_extractor(self.model, {spec.options.get("node", "flatten"): "out"})

    def outputs(self, batch: list[np.ndarray]) -> Any:
        return super().outputs(batch)["out"]


def register() -> None:
    for name in CLASSIFIERS:
        register_model_type("pytorch", name, type(name, (TorchClassification,), {"network": name}))
    for name in DETECTORS:
        register_model_type("pytorch", name, type(name, (TorchDetection,), {"network": name}))
    for name, kind in {"classification": TorchClassification, "detection": TorchDetection, "class_scores": ClassScores, "feature_extractor": FeatureExtractor, "model": TorchModel}.items():
        register_model_type("pytorch", name, kind)


register()
