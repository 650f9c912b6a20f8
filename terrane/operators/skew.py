"""Joins to a table of unique keys when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most this many keys can each hold more than 1/HOT_SHARE of all rows.
HOT_SHARE = 2000
HOT_LEAST = 200
#: A table is broadcast only if its measured values take at most so many bytes.
MOST_BYTES = 64 << 20


def hot_limit(rows: int) -> int:
    """Rows from which a key counts as hot. At most HOT_SHARE keys can reach it, whatever the data."""
    return max(HOT_LEAST, -(-rows // HOT_SHARE))


def measured_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of one value: eight for numbers and for what each string, list or row adds."""
    if isinstance(kind, T.StringType | T.BinaryType):
        size = F.octet_length(value) + 8
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(value, F.lit(8).cast("bigint"), lambda a, x: a + measured_bytes(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        size = measured_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + measured_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = sum((measured_bytes(value[f.name], f.dataType) for f in kind), F.lit(8))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("bigint"), F.lit(8).cast("bigint"))


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row of ``df``."""
    return sum((measured_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16).cast("bigint"))


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "left", most: int | None = None) -> DataFrame:
    """``left`` joined to ``right`` on ``key``; ``right`` has each key once and its count in ``left`` as ``weight``.

    A ``right`` of at most MOST_BYTES (``most``) is broadcast whole. Beyond that, keys with more than ``hot_limit`` rows
    are joined by broadcast: the counts prove that there are at most HOT_SHARE of them; if even these are too wide, the
    limit rises until they fit. All other keys are shuffled. ``right`` must be cheap to read twice (a written table).
    A null key matches nothing.
    """
    most = MOST_BYTES if most is None else most
    size, total = right.agg(F.sum(row_bytes(right)), F.sum(weight)).first()
    if (size or 0) <= most:
        return left.join(F.broadcast(right), key, how)
    limit = hot_limit(total or 0)
    while (right.filter(F.col(weight) >= limit).agg(F.sum(row_bytes(right))).first()[0] or 0) > most:
        limit *= 2
    hot = right.filter(F.col(weight) >= limit)
    cold = right.filter(F.col(weight) < limit)
    mark = "hot"
    while mark in {*left.columns, *right.columns}:
        mark += "_"
    marked = left.join(F.broadcast(hot.select(key, F.lit(True).alias(mark))), key, "left")
    head = marked.filter(F.col(mark)).drop(mark).join(F.broadcast(hot), key, "inner")
    tail = marked.filter(F.col(mark).isNull()).drop(mark).join(cold, key, how)
    return head.unionByName(tail)
