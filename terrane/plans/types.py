"""Type names and the lattice of wider types."""

from __future__ import annotations

from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
NUMERIC, BIGNUMERIC = T.DecimalType(38, 9), T.DecimalType(38, 18)

#: Names of types that casts accept besides Spark's own.
ALIASES: dict[str, T.DataType] = {
    "STRING": T.StringType(), "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(), "INT64": T.LongType(), "INT": T.LongType(), "SMALLINT": T.LongType(),
    "INTEGER": T.LongType(), "BIGINT": T.LongType(), "TINYINT": T.LongType(), "BYTEINT": T.LongType(), "FLOAT64": T.DoubleType(), "FLOAT": T.DoubleType(),
    "NUMERIC": NUMERIC, "DECIMAL": NUMERIC, "BIGNUMERIC": BIGNUMERIC, "BIGDECIMAL": BIGNUMERIC, "BYTES": T.BinaryType(), "DATE": T.DateType(),
    "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampType(), "TIME": T.TimeType() if hasattr(T, "TimeType") else T.StringType(), "GEOGRAPHY": T.StringType(),
}


def type_of_name(name: str) -> T.DataType | str:
    """A type for a name such as INT64; other names are left to Spark."""
    return ALIASES.get(name.strip().upper(), name)


def name_of(kind: T.DataType) -> str:
    """Short name of a type: INTEGER, STRING, STRUCT<a:INTEGER>, ARRAY<STRING>."""
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{name_of(kind.elementType)}>"
    if isinstance(kind, T.StructType):
        return f"STRUCT<{','.join(f'{f.name}:{name_of(f.dataType)}' for f in kind.fields)}>"
    if isinstance(kind, T.MapType):
        return f"MAP<{name_of(kind.keyType)},{name_of(kind.valueType)}>"
    if isinstance(kind, INTEGERS):
        return "INTEGER"
    if isinstance(kind, FLOATS):
        return "FLOAT"
    if isinstance(kind, T.DecimalType):
        return "NUMERIC" if kind.scale <= 9 else "BIGNUMERIC"
    if hasattr(T, "TimeType") and isinstance(kind, T.TimeType):
        return "TIME"
    plain = {T.StringType: "STRING", T.BooleanType: "BOOLEAN", T.BinaryType: "BYTES", T.DateType: "DATE", T.TimestampNTZType: "DATETIME", T.TimestampType: "TIMESTAMP", T.NullType: "NULL"}
    return next((n for t, n in plain.items() if isinstance(kind, t)), kind.simpleString().upper())


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (*INTEGERS, *FLOATS, T.DecimalType))


def wider_types(kind: T.DataType) -> list[T.DataType]:
    """The type itself, then ever wider ones."""
    text = T.StringType()
    if isinstance(kind, INTEGERS):
        return [T.LongType(), NUMERIC, BIGNUMERIC, T.DoubleType(), text]
    if isinstance(kind, T.DecimalType):
        return ([NUMERIC] if kind.scale <= 9 else []) + [BIGNUMERIC, T.DoubleType(), text]
    if isinstance(kind, FLOATS):
        return [T.DoubleType(), text]
    if isinstance(kind, T.DateType):
        return [kind, T.TimestampNTZType(), T.TimestampType(), text]
    if isinstance(kind, T.TimestampNTZType):
        return [kind, T.TimestampType(), text]
    if isinstance(kind, T.StringType):
        return [text]
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return [kind]
    return [kind, text]


def common_type(left: T.DataType, right: T.DataType) -> T.DataType | None:
    """The narrowest type that both widen to; None if they are equal or have none."""
    if left == right:
        return None
    mine = wider_types(left)
    return next((t for t in wider_types(right) if t in mine), None)


def common_type_name(left: str, right: str) -> str | None:
    """common_type by names; None for unknown names."""
    a, b = (ALIASES.get(x.strip().upper()) for x in (left, right))
    if a is None or b is None:
        return None
    found = a if a == b else common_type(a, b)
    return None if found is None else name_of(found)


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.MapType)
