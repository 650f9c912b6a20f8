"""Errors of this package."""


class IllegalArgumentException(Exception):
    """A value of a kind that is not supported."""


class AnalysisException(Exception):
    """A query that cannot be built from these columns."""


class UnsupportedOperationException(Exception):
    """A call that is not allowed here."""


class DataframeComparatorException(Exception):
    """Two tables that cannot be compared as asked."""


class CombinatorialExplosionError(DataframeComparatorException):
    """Join columns that are far from unique."""
