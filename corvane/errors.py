"""Errors the engine raises on purpose."""

from __future__ import annotations


class CorvaneError(Exception):
    """Base of all errors the engine raises on purpose."""


class ConfigurationError(CorvaneError):
    pass


class DataError(CorvaneError):
    pass


class CorpusNotFoundError(DataError):
    pass


class SchemaError(DataError):
    pass


class EmptyCorpusError(DataError):
    pass


class ModelError(CorvaneError):
    pass


class NotTrainedError(ModelError):
    pass


class MismatchError(ModelError):
    pass


class StaleIndexError(MismatchError):
    pass


class IndexBuildError(ModelError):
    pass


class ResourceError(CorvaneError):
    pass
