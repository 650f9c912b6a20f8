"""Helpers over whole tables: joins by name of their kind, unions, printing."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from terrane.errors import AnalysisException
from terrane.operators.nested import quoted

#: Accepted names of each kind of join.
JOINS = {
    "inner": "inner", "cross": "cross", "full": "full", "outer": "full", "fullouter": "full", "full_outer": "full", "left": "left", "leftouter": "left", "left_outer": "left",
    "right": "right", "rightouter": "right", "right_outer": "right", "semi": "left_semi", "leftsemi": "left_semi", "left_semi": "left_semi",
    "anti": "left_anti", "leftanti": "left_anti", "left_anti": "left_anti",
}


def join(left: DataFrame, right: DataFrame, on: str | list[str] | Column | list[Column] | None = None, how: str | None = None) -> DataFrame:
    """Spark's join; the kind must be a known name. Columns in a list are joined by AND."""
    kind = JOINS.get((how or "inner").lower())
    if kind is None:
        raise AssertionError(f"unknown join '{how}': use one of {sorted(JOINS)}")
    if kind == "cross":
        return left.crossJoin(right)
    if isinstance(on, (list, tuple)) and on and isinstance(on[0], Column):
        on = functools.reduce(Column.__and__, on)
    return left.join(right, on, kind)


def with_column(df: DataFrame, name: str, value: Column, replace: bool = False) -> DataFrame:
    """A column more; an existing one only with ``replace``."""
    if name in df.columns and not replace:
        raise AnalysisException(f"column '{name}' exists: pass replace=True to change it")
    return df.withColumn(name, value)


def union_by_name(left: DataFrame, right: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Rows of both by column name: the left's columns first, then the right's own."""
    if not allow_missing and set(left.columns) != set(right.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    return left.unionByName(right, allowMissingColumns=allow_missing)


def item(df: DataFrame, key: str | int | Column | list) -> Column | DataFrame:
    """df[key]: a column by name or number, a filter, or a selection."""
    if isinstance(key, str):
        return df[key]
    if isinstance(key, int):
        return quoted(df.columns[key])
    return df.filter(key) if isinstance(key, Column) else df.select(*key)


def _cell(value, simple: bool) -> str:
    if value is None:
        return "null"
    if isinstance(value, Row):
        if simple:
            return "{" + ", ".join(_inner(v, simple) for v in value) + "}"
        return str({k: _plain(v) for k, v in value.asDict().items()})
    if isinstance(value, list):
        return "[" + ", ".join(_inner(v, simple) for v in value) + "]" if simple else str([_plain(v) for v in value])
    return str(value)


def _plain(value):
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _inner(value, simple: bool) -> str:
    return "None" if value is None else _cell(value, simple)


def table_text(columns: list[str], rows: list, simplify_structs: bool = False) -> str:
    """Right-aligned cells in a frame."""
    cells = [[_cell(v, simplify_structs) for v in r] for r in rows]
    widths = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(columns)]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    shown = ["|" + "|".join(f" {v:>{w}} " for v, w in zip(r, widths, strict=True)) + "|" for r in [columns, *cells]]
    return "\n".join([line, shown[0], line, *shown[1:], line])


def show_string(df: DataFrame, n: int = 20, simplify_structs: bool = False) -> str:
    """The first rows as text, and a note if there are more."""
    rows = df.limit(n + 1).collect()
    text = table_text(df.columns, rows[:n], simplify_structs)
    return text + f"\nonly showing top {n} row{'s' if n != 1 else ''}" * (len(rows) > n)


def show(df: DataFrame, n: int = 20, simplify_structs: bool = False) -> None:
    print(show_string(df, n, simplify_structs))


def compile(df: DataFrame) -> str:  # noqa: A001
    """The plan that runs, as text; the same for the same steps."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer expects the result to hold."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def human_bytes(size: float) -> str:
    """1536 -> 1.50 KiB"""
    for unit in ("B", "KiB", "MiB", "GiB", "TiB", "PiB"):
        if abs(size) < 1024 or unit == "PiB":
            return f"{size:.0f} {unit}" if unit == "B" else f"{size:.2f} {unit}"
        size /= 1024
    raise AssertionError


def observed(df: DataFrame, name: str = "stats"):
    """The table with an observation of its rows, filled when it is run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen

