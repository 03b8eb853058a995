"""A session with models: ``Engine(spark).sql(...)``."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocellus.errors import ModelNotFoundError
from ocellus.sql.catalog import Catalog, MemoryCatalog, Model
from ocellus.sql.ddl import CreateModel, DescribeModel, DropModel, ShowModels, parse_statement, tokens_of
from ocellus.sql.models import model_type_of, run
from ocellus.sql.registry import Registries, Resolved, SqlExpression
from ocellus.sql.spec import ModelSpec, dotted
from ocellus.workers import importable

LISTED = "name string, flavor string, uri string, options string"


def predictor(spec: ModelSpec):
    """A vectorised UDF over any number of columns: one Arrow hop each way, structs included."""
    model = model_type_of(spec)
    kind = spec.returns(model.schema())

    def predict(batches: Iterator[tuple[pd.Series | pd.DataFrame, ...]]) -> Iterator[pd.Series | pd.DataFrame]:
        def columns() -> Iterator[list]:
            for batch in batches:
                yield list(batch) if isinstance(batch, tuple) else [batch]

        for out in run(spec, model, columns()):
            if isinstance(kind, T.StructType):
                yield pd.DataFrame([v or dict.fromkeys(kind.names) for v in out], columns=kind.names)
            else:
                yield pd.Series(out, dtype=object)

    return F.pandas_udf(predict, kind, F.PandasUDFType.SCALAR_ITER)


class Engine:
    """Models of one Spark session.

    The catalog is ``spark.ocellus.catalog.impl`` (a dotted path) or in memory;
    ``spark.ocellus.registry.<scheme>.impl`` adds registries, and
    ``spark.ocellus.registry.uri.root`` is put before URIs without a scheme.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark = importable(spark)
        impl = spark.conf.get("spark.ocellus.catalog.impl", None)
        self.catalog = catalog or (dotted(impl)() if impl else MemoryCatalog())
        self.registries = Registries(spark.conf.get("spark.ocellus.registry.uri.root", None) or "file:/")
        for key, value in dict(spark.conf.getAll).items():
            if found := re.fullmatch(r"spark\.ocellus\.registry\.([^.]+)\.impl", key):
                self.registries.register(found[1], value)
        self._resolved: dict[str, Resolved] = {}

    def sql(self, text: str) -> DataFrame:
        """Runs one of the model statements, or any other SQL, in which ML_PREDICT may stand."""
        statement = parse_statement(text)
        if isinstance(statement, CreateModel):
            self.create(statement)
            return self.spark.createDataFrame([], "result string")
        if isinstance(statement, DropModel):
            self.catalog.drop(statement.name)
            self._resolved.pop(statement.name, None)
            return self.spark.createDataFrame([], "result string")
        if isinstance(statement, DescribeModel):
            return self._listed([self.catalog.get(statement.name)])
        if isinstance(statement, ShowModels):
            return self._listed(self.catalog.list())
        return self.spark.sql(self.rewritten(text))

    def _listed(self, models: list[Model]) -> DataFrame:
        return self.spark.createDataFrame([(m.name, m.flavor or "", m.uri, m.options_json) for m in models], LISTED)

    def create(self, create: CreateModel) -> None:
        if create.if_not_exists and self.catalog.exists(create.name):
            return
        model = Model(create.name, create.uri, create.flavor, create.model_type, create.returns, dict(create.options))
        if self.catalog.exists(create.name) and not create.or_replace:
            self.catalog.create(model)  # raises
        resolved = self.registries.resolve(create)
        if isinstance(resolved, ModelSpec):
            model_type_of(resolved)
            model = Model(create.name, resolved.uri or create.uri, resolved.flavor, resolved.model_type, resolved.schema, resolved.options)
        self.catalog.create(model, replace=create.or_replace)
        self._resolved[create.name] = resolved

    def _resolve(self, name: str) -> Resolved:
        if name not in self._resolved:
            m = self.catalog.get(name)
            self._resolved[name] = self.registries.resolve(CreateModel(m.name, flavor=m.flavor, model_type=m.model_type, options=m.options, returns=m.returns, uri=m.uri))
        return self._resolved[name]

    def predict(self, name: str, *columns: Column | str) -> Column:
        """A model's prediction as a Column named after it."""
        resolved = self._resolve(name)
        if isinstance(resolved, SqlExpression):
            if not all(isinstance(c, str) for c in columns):
                raise TypeError("models of the sql registry take columns by name here")
            return F.expr(self._call(name, resolved, [f"`{c}`" for c in columns])).alias(name)
        return predictor(resolved)(*[F.col(c) if isinstance(c, str) else c for c in columns]).alias(name)

    def _call(self, name: str, resolved: Resolved, arguments: list[str]) -> str:
        """SQL that stands for a prediction."""
        if isinstance(resolved, SqlExpression):
            body = resolved.template.replace("{*}", ", ".join(arguments))
            for i, a in enumerate(arguments):
                body = body.replace(f"{{{i}}}", f"({a})")
            return f"({body})"
        function = f"_ocellus_{name}"
        self.spark.udf.register(function, predictor(resolved))
        return f"{function}({', '.join(arguments)})"

    def _named(self, first: str) -> str:
        """The model that ML_PREDICT's first argument names; a quoted URI gets a name of its own."""
        if first[:1] not in "'\"":
            return first.strip("`")
        uri = first[1:-1]
        name = "uri_" + hashlib.sha256(uri.encode()).hexdigest()[:12]
        if not self.catalog.exists(name):
            self.create(CreateModel(name, uri=uri))
        return name

    def rewritten(self, text: str) -> str:
        """The text with each ML_PREDICT call replaced by the model's function.

        A call that is a whole item of a SELECT list without an alias is named
        after its model.
        """
        if not any(k == "word" and t.lower() == "ml_predict" for k, t in tokens_of(text)):
            return text
        at = 0
        while found := _call_at(text, at):
            start, arguments, end = found
            if len(arguments) < 2:
                raise ValueError("ML_PREDICT needs a model and at least one column")
            name = self._named(arguments[0].strip())
            try:
                resolved = self._resolve(name)
            except ModelNotFoundError as e:
                raise ModelNotFoundError(f"Unsupported model: {name}") from e
            call = self._call(name, resolved, [self.rewritten(a.strip()) for a in arguments[1:]])
            if _is_item(text, start, end):
                call += f" AS `{name}`"
            text = text[:start] + call + text[end:]
            at = start + len(call)
        return text


_SKIP = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.S)


def _call_at(text: str, at: int) -> tuple[int, list[str], int] | None:
    """The next ML_PREDICT call: where it begins, its arguments, and where it ends."""
    while at < len(text):
        if skip := _SKIP.match(text, at):
            at = skip.end()
            continue
        if head := re.compile(r"\bml_predict\s*\(", re.I).match(text, at):
            depth, arguments, first, i = 1, [], head.end(), head.end()
            while i < len(text) and depth:
                if skip := _SKIP.match(text, i):
                    i = skip.end()
                    continue
                c = text[i]
                depth += (c in "([") - (c in ")]")
                if depth == 0 or depth == 1 and c == ",":
                    arguments.append(text[first:i])
                    first = i + 1
                i += 1
            return at, [a for a in arguments if a.strip()], i
        at += 1
    return None


def _is_item(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] is a whole SELECT item without an alias."""
    before, after = text[:start].rstrip(), text[end:].lstrip()
    if not (re.search(r"\bselect(\s+(all|distinct))?$", before, re.I) or before.endswith(",") and _in_select_list(before)):
        return False
    return not after or after[0] in ",;)" or bool(re.match(r"(from|where|limit|order|group|having|union|lateral)\b", after, re.I))


def _in_select_list(before: str) -> bool:
    """Whether a comma at the end of a text separates SELECT items (and not arguments)."""
    depth = 0
    words = list(re.finditer(r"[()]|\b(select|from)\b", _SKIP.sub(lambda m: " " * len(m[0]), before), re.I))
    for m in reversed(words):
        token = m[0].lower()
        if token == ")":
            depth += 1
        elif token == "(":
            if depth == 0:
                return False
            depth -= 1
        elif depth == 0:
            return token == "select"
    return False
