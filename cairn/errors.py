"""Errors of the engine; each has the status a service would answer with."""


class EngineError(ValueError):
    """A request that can't be carried out as written."""

    status = 400


class SqlSyntaxError(EngineError):
    """Text outside the dialect."""


class NotFound(EngineError):
    """A table or file that isn't there."""

    status = 404


class AlreadyExists(EngineError):
    """A table name that is taken."""

    status = 409


class LockTimeout(EngineError):
    """A lock that others held for too long."""

    status = 423
