"""Comparison of two tables: schema, rows, and values by column, at every granularity of nested fields."""

from terrane.diff.compare import compare_dataframes
from terrane.diff.result import DiffFormatOptions, DiffResult

__all__ = ["DiffFormatOptions", "DiffResult", "compare_dataframes"]
