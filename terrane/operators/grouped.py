"""Grouped aggregation with readable names, and pivot in the same style."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.errors import AnalysisException, UnsupportedOperationException
from terrane.functions import column, get_alias, is_aliased, without_alias
from terrane.plans.paths import STRUCT, after_last
from terrane.plans.schema import flatten_schema
from terrane.plans.types import is_numeric


def value_name(value) -> str:
    """The part of a column name that stands for a pivoted value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, decimal.Decimal):
        return str(value).replace("-", "minus_").replace(".", "_point_")
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return value.isoformat().replace("-", "_")
    if isinstance(value, (str, int)):
        return str(value).replace("-", "minus_") if isinstance(value, int) else value
    raise AnalysisException(f"values of {type(value).__name__} need an aliased Column to be pivoted")


def found_values(values: DataFrame) -> list:
    """The distinct values of a column, sorted; as many as the session allows to be pivoted."""
    most = int(values.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    found = [r[0] for r in values.distinct().orderBy(values.columns[0]).limit(most + 1).collect()]
    if len(found) > most:
        raise AnalysisException(f"more than {most} values to pivot: give the values, or raise spark.sql.pivotMaxValues")
    return found


class Grouped:
    """A table and what it is grouped by; struct paths give columns named by their last part."""

    def __init__(self, df: DataFrame, keys: Iterable[str | Column], pivot_column: str | None = None, pivot_values: list | None = None):
        self.df, self.keys, self.pivot_column, self.pivot_values = df, list(keys), pivot_column, pivot_values

    def _by(self) -> list[Column]:
        return [F.col(k).alias(after_last(k, STRUCT)) if isinstance(k, str) else k for k in self.keys]

    def agg(self, *cols: Column | list[Column]) -> DataFrame:
        listed = list(cols[0]) if len(cols) == 1 and isinstance(cols[0], (list, tuple)) else list(cols)
        if self.pivot_column is None:
            return self.df.groupBy(*self._by()).agg(*listed)
        return self._pivoted(listed)

    def _pivoted(self, aggs: list[Column]) -> DataFrame:
        """Columns aggregate by aggregate: ``{alias}_{value}``, or just the value for one aggregate without alias."""
        values = self.pivot_values
        if values is None:
            values = found_values(self.df.select(F.col(self.pivot_column).alias("v")))
        for v in values:
            if isinstance(v, Column) and not is_aliased(v):
                raise AnalysisException("a Column among the pivoted values needs an alias")
        names = [get_alias(v) if isinstance(v, Column) else value_name(v) for v in values]
        values = [without_alias(v)._jc if isinstance(v, Column) else v for v in values]
        plain = len(aggs) == 1 and not is_aliased(aggs[0])
        labels = self.df.agg(*aggs).columns
        keyed = self.df.groupBy(*self._by()).pivot(self.pivot_column, values).agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)])
        n = len(keyed.columns) - len(values) * len(aggs)
        flat = keyed.toDF(*keyed.columns[:n], *[f"p{k}" for k in range(len(values) * len(aggs))])
        out = [F.col(f"`{c}`") for c in keyed.columns[:n]]
        for i, label in enumerate(labels):
            out += [F.col(f"p{k * len(aggs) + i}").alias(name if plain else f"{label}_{name}") for k, name in enumerate(names)]
        return flat.select(*out)

    def _numeric(self, function, prefix: str, cols: tuple[str, ...]) -> DataFrame:
        kinds = {f.name: f.dataType for f in flatten_schema(self.df.schema, explode=False)}
        chosen = list(cols) or [f.name for f in self.df.schema.fields if is_numeric(f.dataType)]
        for c in chosen:
            if c not in kinds or not is_numeric(kinds[c]):
                raise AnalysisException(f"'{c}' is not a numeric column")
        if self.pivot_column is not None and len(chosen) == 1:
            return self.agg(function(F.col(chosen[0])))
        return self.agg(*[function(F.col(c)).alias(f"{prefix}_{after_last(c, STRUCT)}") for c in chosen])

    def avg(self, *cols: str) -> DataFrame:
        return self._numeric(F.avg, "avg", cols)

    def mean(self, *cols: str) -> DataFrame:
        return self._numeric(F.avg, "mean", cols)

    def max(self, *cols: str) -> DataFrame:
        return self._numeric(F.max, "max", cols)

    def min(self, *cols: str) -> DataFrame:
        return self._numeric(F.min, "min", cols)

    def sum(self, *cols: str) -> DataFrame:
        return self._numeric(F.sum, "sum", cols)

    def count(self) -> DataFrame:
        return self.agg(F.count(F.lit(1)).alias("count"))

    def pivot(self, pivot_column: str, values: list | None = None) -> Grouped:
        """One column for each value, which may be a literal Column with an alias; values that are not given are found first."""
        if self.pivot_column is not None:
            raise UnsupportedOperationException("a pivot cannot be pivoted again")
        return Grouped(self.df, self.keys, pivot_column, values)


def group_by(df: DataFrame, *keys: str | Column | list) -> Grouped:
    return Grouped(df, keys[0] if len(keys) == 1 and isinstance(keys[0], (list, tuple)) else [k if isinstance(k, str) else column(k) for k in keys])
