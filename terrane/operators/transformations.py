"""Transformations that follow the schema of any table."""

from __future__ import annotations

import functools
import re
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.errors import AnalysisException
from terrane.functions import is_aliased
from terrane.operators.grouped import found_values
from terrane.operators.nested import build_from_schema, quoted
from terrane.plans.schema import flatten_schema
from terrane.plans.types import common_type, orderable


def flatten(df: DataFrame, struct_separator: str = "_") -> DataFrame:
    """Fields of structs as columns; arrays are left alone."""

    def read(path: str) -> Column:
        first, *rest = path.split("\0")
        return functools.reduce(lambda c, n: c[n], rest, quoted(first))

    found = flatten_schema(df.schema, explode=False, struct_separator="\0")
    return df.select(*[read(f.name).alias(f.name.replace("\0", struct_separator)) for f in found])


def sort_columns(df: DataFrame) -> DataFrame:
    """Columns in alphabetical order."""
    return df.select(*[quoted(c) for c in sorted(df.columns)])


def union_dataframes(dfs: list[DataFrame]) -> DataFrame:
    """All rows, by position."""
    if not dfs:
        raise ValueError("an empty list of DataFrames has no union")
    return functools.reduce(DataFrame.union, dfs)


def transform_all_fields(df: DataFrame, change: Callable[[Column, T.DataType], Column | None]) -> DataFrame:
    """Every scalar, array element and whole array through ``change``; None leaves it as it is."""
    return df.select(*build_from_schema(df.schema, change))


def sort_all_arrays(df: DataFrame) -> DataFrame:
    """Every array sorted, innermost first; structs by their fields in order."""
    return transform_all_fields(df, lambda c, kind: F.sort_array(c) if isinstance(kind, T.ArrayType) and orderable(kind) else None)


def normalize_arrays(df: DataFrame) -> DataFrame:
    """Former name of sort_all_arrays."""
    warnings.warn("normalize_arrays is now sort_all_arrays", DeprecationWarning, stacklevel=2)
    return sort_all_arrays(df)


# Harmonising.


def get_common_columns(left: T.StructType, right: T.StructType) -> dict[str, T.DataType | None]:
    """Flattened fields on both sides, each with the type both must be cast to, or None."""
    theirs = {f.name: f.dataType for f in flatten_schema(right)}
    return {f.name: common_type(f.dataType, theirs[f.name]) for f in flatten_schema(left) if f.name in theirs}


def _meet(left: T.DataType, right: T.DataType, keep: bool) -> tuple[T.DataType, T.DataType]:
    """What each side becomes: common fields in the left's order and of common types; ``keep`` adds each side's own."""
    if isinstance(left, T.StructType) and isinstance(right, T.StructType):
        theirs = {f.name: f for f in right.fields}
        mine, yours = [], []
        for f in left.fields:
            if f.name in theirs:
                a, b = _meet(f.dataType, theirs[f.name].dataType, keep)
                mine.append(T.StructField(f.name, a))
                yours.append(T.StructField(f.name, b))
            elif keep:
                mine.append(f)
        if keep:
            own = {f.name for f in left.fields}
            yours += [f for f in right.fields if f.name not in own]
        return T.StructType(mine), T.StructType(yours)
    if isinstance(left, T.ArrayType) and isinstance(right, T.ArrayType):
        a, b = _meet(left.elementType, right.elementType, keep)
        return T.ArrayType(a), T.ArrayType(b)
    if left == right:
        return left, right
    wide = common_type(left, right)
    return (left, right) if wide is None else (wide, wide)


def conform(value: Column, kind: T.DataType, to: T.DataType) -> Column:
    """A value rebuilt to another type, structs by field name."""
    if kind == to:
        return value
    if isinstance(kind, T.StructType) and isinstance(to, T.StructType):
        have = {f.name: f.dataType for f in kind.fields}
        return F.when(value.isNotNull(), F.struct(*[conform(value[f.name], have[f.name], f.dataType).alias(f.name) for f in to.fields]))
    if isinstance(kind, T.ArrayType) and isinstance(to, T.ArrayType):
        return F.transform(value, lambda x: conform(x, kind.elementType, to.elementType))
    if isinstance(kind, T.BinaryType) and isinstance(to, T.StringType):
        return F.base64(value)
    return value.cast(to)


def harmonize_dataframes(
    left: DataFrame, right: DataFrame, common_columns: list[str] | dict[str, T.DataType | None] | None = None, keep_missing_columns: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Both tables with their common fields, at any depth, in the left's order and of common types."""
    names = None if common_columns is None else {c.split(".")[0].split("!")[0] for c in common_columns}
    a, b = _meet(left.schema, right.schema, keep_missing_columns)

    def build(df: DataFrame, to: T.StructType) -> DataFrame:
        have = {f.name: f.dataType for f in df.schema.fields}
        return df.select(*[conform(quoted(f.name), have[f.name], f.dataType).alias(f.name) for f in to.fields if names is None or f.name in names])

    return build(left, a), build(right, b)


# Pivoting.


def _names_in(df: DataFrame, aggs: list[Column]) -> set[str]:
    """Names of the columns that aggregates read."""
    read = df.agg(*aggs)._jdf.queryExecution().analyzed().references().mkString("\0")
    return {r.rpartition("#")[0] for r in read.split("\0") if r}


def pivot(df: DataFrame, pivot_column: str, aggs: Column | str | list[Column | str], pivoted_columns: list[str] | None = None) -> DataFrame:
    """One column for each value and aggregate, grouped by every column that neither names.

    A single aggregate without alias gives columns named by the value; else ``{alias}_{value}``, value by value.
    """
    given = list(aggs) if isinstance(aggs, (list, tuple)) else [aggs]
    listed = [F.expr(a) if isinstance(a, str) else a for a in given]
    names = [c for c in df.agg(*listed).columns]
    aliased = [is_aliased(a) or isinstance(t, str) and re.search(r"\sas\s+\S+$", t.strip(), re.I) is not None for a, t in zip(listed, given, strict=True)]
    if len(listed) > 1 and not all(aliased):
        raise AnalysisException("several aggregates must each have an alias")
    used = _names_in(df, listed) | {pivot_column}
    rest = [c for c in df.columns if c.lower() not in {u.lower() for u in used}]
    if pivoted_columns is None:
        pivoted_columns = found_values(df.select(F.col(pivot_column).cast("string")))
    grouped = df.groupBy(*[quoted(c) for c in rest]).pivot(pivot_column, list(pivoted_columns))
    out = grouped.agg(*[a.alias(f"a{i}") for i, a in enumerate(listed)])
    columns = []
    for v in pivoted_columns:
        for i, name in enumerate(names):
            source = f"{v}" if len(listed) == 1 else f"{v}_a{i}"
            columns.append(quoted(source).alias(str(v) if not aliased[i] else f"{name}_{v}"))
    return out.select(*[quoted(c) for c in rest], *columns)


def unpivot(df: DataFrame, pivot_columns: list[str], key_alias: str = "key", value_alias: str = "value", exclude_nulls: bool = False) -> DataFrame:
    """A row for each column that is not an identifier; these must all be of one type."""
    values = [f for f in df.schema.fields if f.name not in pivot_columns]
    kinds = {f.dataType.simpleString() for f in values}
    if len(kinds) > 1:
        raise AnalysisException(f"columns to unpivot must have one type, not {sorted(kinds)}")
    out = df.unpivot([quoted(c) for c in pivot_columns], [quoted(f.name) for f in values], key_alias, value_alias)
    return out.filter(quoted(value_alias).isNotNull()) if exclude_nulls else out
