"""The one error that a faulty query raises."""


class QueryError(ValueError):
    """A query that cannot be read, named or typed."""
