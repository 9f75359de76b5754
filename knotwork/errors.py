"""Errors that queries and schema changes raise."""


class QueryError(Exception):
    """A query that cannot be run: wrong syntax, types, scopes or values."""


class ParseError(QueryError):
    pass


class InferenceError(QueryError):
    """No type fits a variable."""


class SchemaError(QueryError):
    """A schema change that does not fit the schema or the data."""


class WriteError(QueryError):
    """A write that the schema does not allow."""


class ConflictError(QueryError):
    """Another transaction has published a version since this one began."""


class Unsupported(QueryError):
    """Part of the language that has no meaning here yet."""
