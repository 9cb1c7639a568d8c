"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors below."""


class StoreNotFound(EngineError):
    """No store has that name."""


class StoreExists(EngineError):
    """A store of that name is there already."""


class RecordNotFound(EngineError):
    """The store holds no live record of that id."""


class QueryError(EngineError):
    """The query or request is malformed, or compares values that have no order."""


class QueryTimeout(EngineError):
    """The query ran longer than its store allows."""
