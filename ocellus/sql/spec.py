"""Model specs: what a model is, where it lies and what it returns."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any
from urllib.parse import urljoin, urlparse

from pyspark.sql import types as T

from ocellus.errors import SpecError
from ocellus.sources.uri import read_bytes
from ocellus.sql.schema import parse_schema

VERSION = "1.0"


@dataclass(frozen=True)
class ModelSpec:
    name: str
    uri: str | None = None
    flavor: str | None = None
    model_type: str | None = None
    schema: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    labels: tuple[str, ...] | None = None
    version: str = VERSION

    def returns(self, default: str) -> T.DataType:
        return parse_schema(self.schema or default)


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with the values of ``over`` that are not None, dicts key by key."""
    out = dict(base)
    for k, v in over.items():
        if isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
            out[k] = merged(out[k], v)
        elif v is not None:
            out[k] = v
    return out


def validated(spec: Mapping[str, Any]) -> None:
    """A spec needs a version and a model: its URI, or else its flavor and type."""
    if spec.get("version") is None or not isinstance(spec.get("model"), Mapping):
        raise SpecError("a spec needs version and model")
    if str(spec["version"]) != VERSION:
        raise SpecError(f"spec version {spec['version']} is not supported")
    model = spec["model"]
    for key in ("flavor", "type"):
        if key in model and not model[key]:
            raise SpecError(f"model.{key} is empty")
    if not model.get("uri") and not (model.get("flavor") and model.get("type")):
        raise SpecError("a model needs a uri, or a flavor and a type")


def labels_of(spec: Mapping[str, Any], base: str | None = None) -> tuple[str, ...] | None:
    """Names of classes: listed in the JSON at ``labels.uri``, or returned by the function ``labels.func`` names."""
    labels = spec.get("labels") or {}
    if uri := labels.get("uri"):
        found = json.loads(read_bytes(uri if base is None or urlparse(uri).scheme or uri.startswith("/") else urljoin(base, uri)))
        return tuple(found) if isinstance(found, list) else tuple(found[str(i)] for i in range(len(found)))
    if path := labels.get("func"):
        function: Callable = dotted(path)
        out, i = [], 0
        while (name := function(i)) is not None:
            out.append(name)
            i += 1
        return tuple(out)
    return None


def dotted(path: str) -> Any:
    """The object that a dotted path names."""
    module, _, name = path.rpartition(".")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise SpecError(f"can not find {path}") from e


def spec_of(name: str, raw: Mapping[str, Any], base: str | None = None) -> ModelSpec:
    """A validated spec; a relative artifact is resolved against the spec's place."""
    validated(raw)
    model = raw["model"]
    uri = model.get("uri")
    if uri and base and not urlparse(uri).scheme and not uri.startswith("/"):
        uri = urljoin(base, uri)
    options = {str(k): str(v) for k, v in (raw.get("options") or {}).items()}
    return ModelSpec(name, uri, model.get("flavor"), model.get("type"), raw.get("schema"), options, labels_of(raw, base), str(raw["version"]))


def with_name(spec: ModelSpec, name: str) -> ModelSpec:
    return replace(spec, name=name)
