"""What can go wrong, one class for each kind."""


class LodestoneError(Exception):
    """Any error of this library."""


class IllegalArgument(LodestoneError, ValueError):
    """A value, a schema or a query that makes no sense."""


class QueryParse(LodestoneError, ValueError):
    """A query string that can't be read."""


class IndexNotFound(LodestoneError):
    """No commit where an index was expected."""


class Corrupt(LodestoneError):
    """Files of an index that are missing or damaged."""


class LockObtainFailed(LodestoneError):
    """Another writer holds the index."""


class StorageError(LodestoneError, OSError):
    """A file system that refuses."""
