"""Errors that a session raises."""


class QueryError(Exception):
    """A statement can't be planned or run."""


class MisuseError(Exception):
    """The interface is used wrongly, a closed session for one."""
