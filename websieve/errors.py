"""Exceptions of the engine."""


class SieveError(Exception):
    """Base of all errors raised here."""


class QueryError(SieveError, ValueError):
    """A query text that can't be parsed or compiled."""


class InvalidRequest(SieveError, ValueError):
    """A request with missing or out-of-range parts."""


class PermissionDenied(SieveError):
    """An access key without the needed permission."""


class RevisionConflict(SieveError):
    """An update based on an older revision."""


class NotFound(SieveError, KeyError):
    """A key, workspace or blob that doesn't exist."""
