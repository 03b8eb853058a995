"""Catalogs of models: in memory, or as a JSON file that sessions share."""

from __future__ import annotations

import json
import re
import threading
from abc import ABC, abstractmethod
from dataclasses import asdict, dataclass, field

from ocellus.errors import ModelExistsError, ModelNameError, ModelNotFoundError
from ocellus.sources.uri import exists, read_bytes, write_bytes


@dataclass(frozen=True)
class Model:
    name: str
    uri: str | None = None
    flavor: str | None = None
    model_type: str | None = None
    returns: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    @property
    def options_json(self) -> str:
        return json.dumps(self.options, sort_keys=True) if self.options else ""


def checked_name(name: str) -> str:
    """A letter, then up to 255 word characters."""
    if not re.fullmatch(r"[a-zA-Z]\w{0,255}", name, re.ASCII):
        raise ModelNameError(f"{name!r} is no name for a model")
    return name


class Catalog(ABC):
    @abstractmethod
    def all(self) -> dict[str, Model]: ...

    @abstractmethod
    def _store(self, models: dict[str, Model]) -> None: ...

    def __init__(self) -> None:
        self._lock = threading.RLock()

    def exists(self, name: str) -> bool:
        return checked_name(name) in self.all()

    def get(self, name: str) -> Model:
        found = self.all().get(checked_name(name))
        if found is None:
            raise ModelNotFoundError(f"no model {name!r}")
        return found

    def list(self) -> list[Model]:
        return [m for _, m in sorted(self.all().items())]

    def create(self, model: Model, replace: bool = False) -> None:
        with self._lock:
            models = dict(self.all())
            if checked_name(model.name) in models and not replace:
                raise ModelExistsError(f"there is a model {model.name!r}")
            models[model.name] = model
            self._store(models)

    def drop(self, name: str) -> None:
        with self._lock:
            self.get(name)
            self._store({k: v for k, v in self.all().items() if k != name})


class MemoryCatalog(Catalog):
    def __init__(self) -> None:
        super().__init__()
        self._models: dict[str, Model] = {}

    def all(self) -> dict[str, Model]:
        return self._models

    def _store(self, models: dict[str, Model]) -> None:
        self._models = models


class FileCatalog(Catalog):
    """Models in a JSON file at a URI."""

    def __init__(self, uri: str) -> None:
        super().__init__()
        self.uri = uri

    def all(self) -> dict[str, Model]:
        if not exists(self.uri):
            return {}
        return {m["name"]: Model(**m) for m in json.loads(read_bytes(self.uri))}

    def _store(self, models: dict[str, Model]) -> None:
        write_bytes(self.uri, json.dumps([asdict(m) for m in models.values()]).encode())
