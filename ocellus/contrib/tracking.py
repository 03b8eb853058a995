"""Logging of models to an MLflow server, with what ``mlflow:/`` URIs need to find them."""

from __future__ import annotations

import json
from typing import Any


def log_model(flavor: str, model: Any, path: str, schema: str | None = None, name: str | None = None, model_type: str | None = None, options: dict | None = None, **rest: Any) -> Any:
    """Logs a model by its flavor's own logger, and tags the run and, if named, the version."""
    try:
        import mlflow
    except ImportError as e:
        raise ImportError("log_model needs MLflow") from e
    tags = {"ocellus.flavor": flavor, "ocellus.model_type": model_type, "ocellus.schema": schema, "ocellus.options": json.dumps(options or {}), "ocellus.path": path}
    tags = {k: v for k, v in tags.items() if v is not None}
    info = getattr(mlflow, flavor).log_model(model, path, registered_model_name=name, **rest)
    mlflow.set_tags(tags)
    if name:
        client = mlflow.tracking.MlflowClient()
        version = client.get_latest_versions(name)[0].version
        for key, value in tags.items():
            client.set_model_version_tag(name, version, key, value)
    return info
