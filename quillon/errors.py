"""Errors that callers can tell apart."""


class QuillonError(Exception):
    """Base of this package's errors."""


class DuplicateObjectError(QuillonError):
    """A table, an index or a column of that name is there already."""


class NoSuchObjectError(QuillonError):
    """No table, index or column of that name."""


class TypeMismatchError(QuillonError):
    """The sides of a comparison have different types, or a value does not fit its column."""


class ConflictError(QuillonError):
    """Another transaction has committed to a table that this one has changed."""


class UnsupportedError(QuillonError):
    """A statement outside the SQL that the engine takes."""
