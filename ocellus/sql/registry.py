"""Registries: from a model's URI and clauses to its spec."""

from __future__ import annotations

import json
import re
from abc import ABC, abstractmethod
from dataclasses import dataclass
from typing import Any
from urllib.parse import urlparse

from ocellus.errors import ModelResolveError, SpecError
from ocellus.sources.uri import normalize, read_bytes
from ocellus.sql.ddl import CreateModel
from ocellus.sql.spec import VERSION, ModelSpec, dotted, merged, spec_of


@dataclass(frozen=True)
class SqlExpression:
    """A model that is a Spark expression: ``template`` with ``{0}``, ``{1}``, ... for its arguments."""

    template: str


Resolved = ModelSpec | SqlExpression


class Registry(ABC):
    @abstractmethod
    def resolve(self, create: CreateModel) -> Resolved:
        """What a CREATE MODEL statement describes."""


def _clauses(create: CreateModel) -> dict[str, Any]:
    return {"name": create.name, "schema": create.returns, "model": {"flavor": create.flavor, "type": create.model_type}, "options": create.options or None}


class FileRegistry(Registry):
    """An artifact, or a YAML spec that the statement's clauses override."""

    def resolve(self, create: CreateModel) -> ModelSpec:
        uri = create.uri or ""
        if not re.search(r"\.ya?ml$", uri):
            raw = merged({"version": VERSION, "model": {"uri": uri}}, _clauses(create))
            raw["model"] = {k: v for k, v in raw["model"].items() if v is not None}
            return spec_of(create.name, raw)
        import yaml

        base = normalize(uri)
        found = yaml.safe_load(read_bytes(base)) or {}
        if not isinstance(found, dict):
            raise SpecError(f"{uri} is no spec")
        return spec_of(create.name, merged(found, _clauses(create)), base)


class BuiltInRegistry(Registry):
    """No USING clause: a pretrained type, or parameters among the options."""

    def resolve(self, create: CreateModel) -> ModelSpec:
        from ocellus.sql.models import model_type_of

        spec = ModelSpec(create.name, None, create.flavor, create.model_type, create.returns, dict(create.options))
        if not (getattr(model_type_of(spec), "pretrained", False) or "parameters" in spec.options or spec.model_type in ("classification", "detection")):
            raise ModelResolveError(f"{create.name} has no URI, and its type is not pretrained")
        return spec


class SqlRegistry(Registry):
    """``sql:/name`` or ``sql:expression with {0}``: inference that Catalyst sees and optimises."""

    def resolve(self, create: CreateModel) -> SqlExpression:
        body = (create.uri or "").partition(":")[2].strip("/")
        if re.fullmatch(r"[A-Za-z_]\w*", body):
            return SqlExpression(f"{body}({{*}})")
        if "{0}" not in body:
            raise ModelResolveError(f"{create.uri} has no place for an argument")
        return SqlExpression(body)


class TrackingRegistry(Registry):
    """``mlflow:/name[/version or stage]``; needs MLflow and its tracking server."""

    def resolve(self, create: CreateModel) -> ModelSpec:
        found = re.fullmatch(r"mlflow:/([^/]+)(?:/([^/]+))?", create.uri or "")
        if not found:
            raise ModelResolveError(f"{create.uri} is not mlflow:/name or mlflow:/name/version")
        try:
            from mlflow.tracking import MlflowClient
        except ImportError as e:
            raise ImportError("mlflow:/ URIs need MLflow") from e
        name, want = found[1], found[2]
        client = MlflowClient()
        version = client.get_model_version(name, want) if want and want.isdigit() else client.get_latest_versions(name, [want or "none"])[0]
        tags = {**client.get_run(version.run_id).data.tags, **version.tags}
        raw = {"version": VERSION, "schema": tags.get("ocellus.schema"), "model": {"uri": version.source, "flavor": tags.get("ocellus.flavor"), "type": tags.get("ocellus.model_type")}, "options": json.loads(tags.get("ocellus.options", "{}"))}
        return spec_of(create.name, merged(raw, _clauses(create)))


class Registries:
    """Registries by scheme; URIs without one are put behind ``root``."""

    def __init__(self, root: str = "file:/"):
        self.root = root
        self.by_scheme: dict[str, Registry] = {"file": FileRegistry(), "sql": SqlRegistry(), "test": SqlRegistry(), "mlflow": TrackingRegistry()}
        self.built_in = BuiltInRegistry()

    def register(self, scheme: str, registry: Registry | str) -> None:
        """Adds a registry, or the one that a dotted path names."""
        if not re.fullmatch(r"[a-z][a-z0-9+.-]*", scheme):
            raise ValueError(f"{scheme!r} is no scheme")
        if scheme in self.by_scheme:
            raise ValueError(f"there is a registry for {scheme!r}")
        self.by_scheme[scheme] = dotted(registry)() if isinstance(registry, str) else registry

    def resolve(self, create: CreateModel) -> Resolved:
        if not create.uri:
            return self.built_in.resolve(create)
        uri = create.uri
        if not urlparse(uri).scheme:
            uri = f"{self.root.rstrip('/')}/{uri.lstrip('/')}"
        scheme = urlparse(uri).scheme
        if scheme not in self.by_scheme:
            raise ModelResolveError(f"no registry for {uri}")
        if scheme == "test":
            uri = "sql:/" + uri.rstrip("/").rpartition("/")[2]
        if scheme == "file":
            uri = normalize(re.sub(r"^file:/+", "/", uri))
        return self.by_scheme[scheme].resolve(CreateModel(**{**vars(create), "uri": uri}))
