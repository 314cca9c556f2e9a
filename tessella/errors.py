"""Errors that callers may want to tell apart."""


class TessellaError(Exception):
    """Base of all errors raised on purpose."""


class QueryError(TessellaError):
    """A statement can't be read or can't be carried out."""


class SchemaError(TessellaError):
    """A value or a unique constraint doesn't fit a table."""


class IndexError_(TessellaError):
    """A value can't be indexed."""
