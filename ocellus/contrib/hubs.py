"""Registries of public model hubs: ``torchhub:///org/project[:tag]/model`` and ``tfhub:///publisher/model/version``."""

from __future__ import annotations

import re

from ocellus.errors import ModelResolveError
from ocellus.sql.ddl import CreateModel
from ocellus.sql.registry import Registry
from ocellus.sql.spec import ModelSpec


class TorchHub(Registry):
    def resolve(self, create: CreateModel) -> ModelSpec:
        found = re.fullmatch(r"torchhub:///([^/]+)/([^/:]+)(?::([^/]+))?/([^/]+)", create.uri or "")
        if not found:
            raise ModelResolveError(f"{create.uri} is not torchhub:///org/project[:tag]/model")
        return ModelSpec(create.name, None, create.flavor or "pytorch", create.model_type or found[4], create.returns, {**create.options, "hub": f"{found[1]}/{found[2]}" + (f":{found[3]}" if found[3] else "")})


class TensorFlowHub(Registry):
    def resolve(self, create: CreateModel) -> ModelSpec:
        found = re.fullmatch(r"tfhub:///([^/]+)/(.+)/(\d+)", create.uri or "")
        if not found:
            raise ModelResolveError(f"{create.uri} is not tfhub:///publisher/model/version")
        return ModelSpec(create.name, create.uri, create.flavor or "tensorflow", create.model_type or "model", create.returns, dict(create.options))
