"""Nested-data analytics on Spark DataFrames: paths, transformations, data diff and graphs."""

__version__ = "0.1.0"
