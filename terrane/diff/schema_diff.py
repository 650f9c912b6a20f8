"""Differences between two schemas."""

from __future__ import annotations

import difflib
from dataclasses import dataclass

from pyspark.sql import types as T

from terrane.plans import paths as P
from terrane.plans.schema import Field, flatten_schema
from terrane.plans.types import name_of

SAME, LEFT, RIGHT = " ", "-", "+"


@dataclass(frozen=True)
class SchemaDiffResult:
    """diff_str is empty for equal schemas; column_names_diff tells on which side each column is."""

    same_schema: bool
    diff_str: str
    nb_cols: int
    column_names_diff: dict[str, str]

    @property
    def column_names(self) -> list[str]:
        return list(self.column_names_diff)

    def text(self) -> str:
        if self.same_schema:
            return f"Schema: ok ({self.nb_cols})"
        return f"Schema has changed:\n{self.diff_str}\nWARNING: columns that do not match both sides will be ignored"

    def display(self) -> None:
        print(self.text())


def schema_lines(found: list[Field], nullable: bool = False) -> list[str]:
    """A line for each field: its path and type."""
    return [f"{f.name} {name_of(f.dataType)}" + (f" ({'nullable' if f.nullable else 'required'})" if nullable else "") for f in found]


def visible_fields(schema: T.StructType, join_cols: list[str]) -> list[Field]:
    """Fields as a diff on these keys sees them: arrays are opened only where a key lies inside."""
    opened = {a for c in join_cols for a in P.array_prefixes(c)}
    out = []
    for f in flatten_schema(schema, keep_non_leaf_fields=True):
        prefixes = P.array_prefixes(f.name)
        if any(a not in opened for a in prefixes) or f.name.endswith(P.ARRAY) and isinstance(f.dataType, T.StructType):
            continue
        if isinstance(f.dataType, T.StructType) or f"{f.name}{P.ARRAY}" in opened:
            continue
        out.append(f)
    return out


def diff_schemas(left: T.StructType, right: T.StructType, join_cols: list[str]) -> SchemaDiffResult:
    """Nullability and comments do not count; columns in another order do, for same_schema."""
    mine, yours = visible_fields(left, join_cols), visible_fields(right, join_cols)
    a, b = schema_lines(mine), schema_lines(yours)
    lines = list(difflib.unified_diff(a, b, n=10_000, lineterm=""))
    names = {f.name for f in mine}, {f.name for f in yours}
    order = [f.name for f in mine]
    merged: list[str] = []
    rest = [f.name for f in yours]
    for name in order:  # the right's own columns stay behind their neighbours
        merged.append(name)
        if name in rest:
            at = rest.index(name) + 1
            while at < len(rest) and rest[at] not in names[0]:
                merged.append(rest[at])
                at += 1
    merged = list(dict.fromkeys([*merged, *rest]))
    where = {n: SAME if n in names[0] and n in names[1] else LEFT if n in names[0] else RIGHT for n in merged}
    return SchemaDiffResult(not lines, "\n".join(lines[2:]), len(mine), where)
