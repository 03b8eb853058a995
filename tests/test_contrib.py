"""Adapters without their libraries: what is registered, and clear errors."""

import pandas as pd
import pytest

from ocellus.contrib import hubs, tracking
from ocellus.errors import ModelResolveError, SpecError
from ocellus.sql import Engine
from ocellus.sql.ddl import CreateModel
from ocellus.sql.models import apply_spec, model_type_of
from ocellus.sql.spec import ModelSpec


@pytest.mark.parametrize(("flavor", "kind", "schema"), [("pytorch", "resnet50", "struct"), ("pytorch", "ssd300_vgg16", "array<struct"), ("pytorch", "feature_extractor", "array<float>"), ("tensorflow", "ssd", "array<struct")])
def test_adapters(flavor, kind, schema):
    spec = ModelSpec("m", "file:///none", flavor, kind)
    assert model_type_of(spec).schema().startswith(schema)
    with pytest.raises(ImportError):
        list(apply_spec(spec, iter([[pd.Series([[1.0]])]])))
    with pytest.raises(SpecError):
        model_type_of(ModelSpec("m", None, flavor, "nope"))


def test_hubs(spark):
    made = hubs.TorchHub().resolve(CreateModel("m", uri="torchhub:///org/prj:v1/resnet18", options={"a": "1"}))
    assert (made.flavor, made.model_type, made.options) == ("pytorch", "resnet18", {"a": "1", "hub": "org/prj:v1"})
    assert hubs.TensorFlowHub().resolve(CreateModel("m", uri="tfhub:///pub/ssd/2")).flavor == "tensorflow"
    for registry, uri in ((hubs.TorchHub(), "torchhub:///x"), (hubs.TensorFlowHub(), "tfhub:///x/y")):
        with pytest.raises(ModelResolveError):
            registry.resolve(CreateModel("m", uri=uri))
    engine = Engine(spark)
    engine.registries.register("torchhub", "ocellus.contrib.hubs.TorchHub")
    engine.sql("CREATE MODEL r USING 'torchhub:///org/prj/resnet18'")
    assert engine.sql("DESC MODEL r").first().flavor == "pytorch"


def test_tracking():
    with pytest.raises(ImportError):
        tracking.log_model("sklearn", None, "p")
    with pytest.raises(ImportError):
        Engine.__init__.__globals__["Registries"]().resolve(CreateModel("m", uri="mlflow:/x"))
