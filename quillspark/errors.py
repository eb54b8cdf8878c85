"""Errors that callers can tell apart."""


class QueryError(ValueError):
    """A request that can't be answered as asked: unknown value, reversed range, missing data."""


class IngestError(ValueError):
    """An input file that doesn't hold what it should; names the line or column."""


class LedgerConflict(ValueError):
    """A batch that repeats a transaction with other content; nothing of it was written."""


class InvalidEvent(ValueError):
    """An event that fails validation or contradicts an earlier one; the stream stops there."""
