"""Flat views of nested schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terrane.plans.paths import ARRAY, STRUCT
from terrane.plans.types import name_of


@dataclass(frozen=True)
class Field:
    """A field by its path."""

    name: str
    dataType: T.DataType  # noqa: N815
    nullable: bool = True


def flatten_schema(
    schema: T.StructType, explode: bool = True, keep_non_leaf_fields: bool = False, struct_separator: str = STRUCT, repetition_marker: str = ARRAY
) -> list[Field]:
    """All leaf fields by path, in order. Without ``explode`` arrays are leaves, as maps always are."""
    out: list[Field] = []

    def visit(path: str, kind: T.DataType, nullable: bool) -> None:
        leaf = not isinstance(kind, T.StructType) and not (explode and isinstance(kind, T.ArrayType))
        if leaf or keep_non_leaf_fields:
            out.append(Field(path, kind, nullable))
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                visit(f"{path}{struct_separator}{f.name}", f.dataType, nullable or f.nullable)
        elif explode and isinstance(kind, T.ArrayType):
            visit(f"{path}{repetition_marker}", kind.elementType, nullable or kind.containsNull)

    for f in schema.fields:
        visit(f.name, f.dataType, f.nullable)
    return out


def fields(df: DataFrame, keep_non_leaf_fields: bool = False) -> list[str]:
    """Paths of all fields."""
    return [f.name for f in flatten_schema(df.schema, keep_non_leaf_fields=keep_non_leaf_fields)]


def schema_string(df: DataFrame) -> str:
    """One line for each leaf field, with its type and whether it can be null."""
    lines = [f" |-- {f.name}: {name_of(f.dataType)} (nullable = {str(f.nullable).lower()})" for f in flatten_schema(df.schema)]
    return "\n".join(["root", *lines]) + "\n"


def print_schema(df: DataFrame) -> None:
    print(schema_string(df))


def simple_string(schema: T.StructType) -> str:
    """id:INTEGER,s:STRUCT<a:STRING>"""
    return ",".join(f"{f.name}:{name_of(f.dataType)}" for f in schema.fields)


def tree_string(schema: T.StructType) -> str:
    """An indented line for each field: name, type, and NULLABLE, REQUIRED or REPEATED."""
    lines: list[str] = ["root"]

    def visit(f: T.StructField, depth: int) -> None:
        kind, mode = f.dataType, "NULLABLE" if f.nullable else "REQUIRED"
        if isinstance(kind, T.ArrayType):
            kind, mode = kind.elementType, "REPEATED"
        record = isinstance(kind, T.StructType)
        lines.append(f" {'|    ' * depth}|-- {f.name}: {'RECORD' if record else name_of(kind)} ({mode})")
        if record:
            for x in kind.fields:
                visit(x, depth + 1)

    for f in schema.fields:
        visit(f, 0)
    return "\n".join(lines) + "\n"
