"""Column functions that Spark lacks or spells differently. All others are ``pyspark.sql.functions``."""

from __future__ import annotations

import base64
import builtins
import datetime
import decimal
import re
from collections.abc import Callable
from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.column import Column as ClassicColumn

from terrane.errors import IllegalArgumentException
from terrane.plans.types import BIGNUMERIC, type_of_name

# These are Spark's own and behave as users expect.
approx_count_distinct, asc, avg, coalesce, col, concat, count, desc, explode, explode_outer, expr = (
    F.approx_count_distinct, F.asc, F.avg, F.coalesce, F.col, F.concat, F.count, F.desc, F.explode, F.explode_outer, F.expr
)
isnull, length, lower, max, mean, min, sum, struct, upper, when = (  # noqa: A001
    F.isnull, F.length, F.lower, F.max, F.mean, F.min, F.sum, F.struct, F.upper, F.when
)
from_base64, to_base64, count_distinct = F.unbase64, F.base64, F.count_distinct


def column(value: str | Column) -> Column:
    """A column from its name."""
    return F.col(value) if isinstance(value, str) else value


def literal(value: Any) -> Column:
    return value if isinstance(value, Column) else lit(value)


def lit(value: Any) -> Column:
    """A literal of None, bool, int, float, str, bytes, Decimal, date, time, datetime, list, dict or a Column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, bool) or value is None or isinstance(value, (str, float, bytes, bytearray)):
        return F.lit(value)
    if isinstance(value, int):
        return F.lit(value).cast("bigint")
    if isinstance(value, decimal.Decimal):
        return F.lit(value).cast(BIGNUMERIC)
    if isinstance(value, datetime.datetime):
        text = value.replace(tzinfo=None).isoformat(sep=" ")
        if value.tzinfo is None:
            return F.lit(text).cast("timestamp_ntz")
        return F.lit(value.astimezone(datetime.timezone.utc).isoformat()).cast("timestamp")
    if isinstance(value, datetime.date):
        return F.lit(value)
    if isinstance(value, datetime.time):
        return F.lit(value)
    if isinstance(value, (list, tuple)):
        return F.array(*[lit(v) for v in value])
    if isinstance(value, dict):
        return F.struct(*[lit(v).alias(k) for k, v in value.items()])
    raise IllegalArgumentException(f"lit({value!r}): values of {type(value).__name__} are not supported")


def cast(value: str | Column, kind: str | T.DataType) -> Column:
    """Strict cast; names such as INT64 or FLOAT64 are understood."""
    return column(value).cast(type_of_name(kind) if isinstance(kind, str) else kind)


def array(*cols) -> Column:
    if len(cols) == 1 and isinstance(cols[0], (list, set, tuple)):
        cols = tuple(cols[0])
    return F.array(*[column(c) for c in cols])


def substring(value: str | Column, pos: int | Column, len: int | Column | None = None) -> Column:  # noqa: A002
    """From the 1-based position; to the end without a length."""
    value, pos = column(value), literal(pos)
    return F.substr(value, pos) if len is None else F.substr(value, pos, literal(len))


def replace(value: str | Column, from_value: str | Column, to_value: str | Column) -> Column:
    """Every occurrence; plain strings are literals."""
    return F.replace(column(value), literal(from_value), literal(to_value))


def regexp_replace(value: str | Column, regexp: str | Column, replacement: str | Column) -> Column:
    r"""All matches; a replacement string names groups as \0 to \9."""
    if isinstance(replacement, str):
        parts = re.split(r"(\\[0-9]|\\\\)", replacement)
        replacement = "".join(("$" + p[1] if p[1:].isdigit() else "\\\\") if i % 2 else p.replace("\\", "\\\\").replace("$", "\\$") for i, p in enumerate(parts))
    return F.regexp_replace(column(value), literal(regexp), literal(replacement))


@F.pandas_udf(T.StringType())
def _to_base32(values):
    return values.map(lambda v: None if v is None else base64.b32encode(bytes(v)).decode())


@F.pandas_udf(T.BinaryType())
def _from_base32(values):
    return values.map(lambda v: None if v is None else base64.b32decode(v))


def to_base32(value: str | Column) -> Column:
    """RFC 4648 text of bytes; Arrow batches, as Spark has no such function."""
    return _to_base32(column(value))


def from_base32(value: str | Column) -> Column:
    return _from_base32(column(value))


def hash(*cols) -> Column:  # noqa: A001
    """Signed 64-bit hash of the columns' JSON, nulls included."""
    return F.xxhash64(F.to_json(F.struct(*[column(c) for c in cols]), {"ignoreNullFields": "false"}))


def _sort_keys(keys: Any) -> list[Column]:
    return [column(k) for k in (keys if isinstance(keys, (list, tuple)) else [keys])]


def _direction(key: Column) -> tuple[Column, bool]:
    """A sort key without its direction, and whether it descends."""
    node = key._jc.node()
    if node.getClass().getSimpleName() != "SortOrder":
        return key, False
    plain = SparkContext._jvm.org.apache.spark.sql.Column(node.child())
    return ClassicColumn(plain), "Desc" in node.sortDirection().toString()


def is_aliased(value: Column) -> bool:
    """Whether a column has been given a name."""
    return value._jc.node().getClass().getSimpleName() == "Alias"


def get_alias(value: Column) -> str | None:
    """The name that a column has been given."""
    return value._jc.node().name().mkString(".") if is_aliased(value) else None


def without_alias(value: Column) -> Column:
    """The column before it was named."""
    return ClassicColumn(SparkContext._jvm.org.apache.spark.sql.Column(value._jc.node().child())) if is_aliased(value) else value


def _compare(a: Column, b: Column, descending: bool) -> Column:
    """-1, 0 or 1; nulls come first when ascending and last when descending."""
    order = F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    return -order if descending else order


def sort_array(value: str | Column, sort_keys: Callable[[Column], Any] | None = None) -> Column:
    """Sorted elements; by the keys of each element, which may be mixed ``asc()`` and ``desc()``."""
    value = column(value)
    if sort_keys is None:
        return F.sort_array(value)

    def order(x: Column, y: Column) -> Column:
        pairs = zip(_sort_keys(sort_keys(x)), _sort_keys(sort_keys(y)), strict=True)
        parts = [_compare(_direction(a)[0], _direction(b)[0], _direction(a)[1]) for a, b in pairs]
        out = F.lit(0)
        for part in reversed(parts):
            out = F.when(part != 0, part).otherwise(out)
        return out

    return F.array_sort(value, lambda x, y: order(x, y))


def transform(value: str | Column, func: Callable[[Column], Column]) -> Column:
    """Each element through a function of one argument."""
    return F.transform(column(value), lambda x: func(x))


def array_agg(value: str | Column, order_by: Any = None, distinct: bool = False, ignore_nulls: bool = False, limit: int | None = None) -> Column:
    """Values of a group as an array: nulls kept unless ignored, sorted by keys, without repeats, at most ``limit``.

    Of repeated values the one that sorts first stays. ``limit`` applies after the whole group is gathered.
    """
    value = column(value)
    keys = [] if order_by is None else _sort_keys(order_by)
    pairs = [_direction(k) for k in keys]
    fields = [value.alias("v"), *[k.alias(f"k{i}") for i, (k, _) in enumerate(pairs)]]
    entry = F.struct(*fields)
    collected = F.collect_set(entry) if distinct else F.collect_list(entry)
    if ignore_nulls:
        collected = F.filter(collected, lambda x: x["v"].isNotNull())
    if pairs:

        def order(x: Column, y: Column) -> Column:
            out = F.lit(0)
            for i, (_, descending) in reversed(list(enumerate(pairs))):
                part = _compare(x[f"k{i}"], y[f"k{i}"], descending)
                out = F.when(part != 0, part).otherwise(out)
            return out

        collected = F.array_sort(collected, lambda x, y: order(x, y))
    elif distinct:
        collected = F.array_sort(collected)
    values = F.transform(collected, lambda x: x["v"])
    if distinct:
        values = F.array_distinct(values)
    return values if limit is None else F.slice(values, 1, limit)


def posexplode(value: str | Column, alias: str, outer: bool = False) -> list[Column]:
    """Generator columns ``alias`` and ``alias_pos`` (0-based), to be selected in this order."""
    value = column(value)
    rows = F.transform(value, lambda x, i: F.struct(x.alias(alias), i.cast("bigint").alias(f"{alias}_pos")))
    return [(F.inline_outer if outer else F.inline)(rows)]


def posexplode_outer(value: str | Column, alias: str) -> list[Column]:
    return posexplode(value, alias, outer=True)


def approx_top_count(value: str | Column, number: int = 100) -> Column:
    """Most frequent values with their counts, approximately; nulls count as a value."""
    return F.call_function("approx_top_k", column(value), F.lit(number), F.lit(builtins.max(10_000, number)))
