"""Errors of the library."""


class ColumnNotFoundError(IOError):
    """A dataset lacks a column that was asked for."""


class SpecError(ValueError):
    """A model spec is invalid."""


class SchemaError(ValueError):
    """Text in the schema language is invalid."""


class ModelError(Exception):
    """Base of the model catalog's errors."""


class ModelNameError(ModelError):
    """A model's name is invalid."""


class ModelExistsError(ModelError):
    """A model of that name exists already."""


class ModelNotFoundError(ModelError):
    """There is no model of that name."""


class ModelResolveError(ModelError):
    """No registry can resolve a model's URI."""
