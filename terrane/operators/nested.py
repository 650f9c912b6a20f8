"""Select, change and add fields at any depth, and unnest them.

Paths name fields (see ``plans.paths``). Only structs and arrays on the way to a named field are rebuilt; all else is
passed on as it is, so Spark can prune what is not read. A null struct stays null and a null array stays null.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.errors import AnalysisException
from terrane.operators.printable import PrintableFunction, box
from terrane.plans import paths as P
from terrane.plans.schema import fields, flatten_schema, print_schema, schema_string

__all__ = [
    "build_from_schema", "fields", "print_schema", "resolve", "schema_string", "select", "select_nested_columns", "show_resolved", "unnest_all_fields", "unnest_field", "unnest_fields", "with_fields",
    "with_nested_columns",
]

Transformation = None | str | Column | Callable[..., Column] | PrintableFunction


class _Tree:
    """Steps of several paths merged by common beginnings, in order of first appearance."""

    def __init__(self) -> None:
        self.children: dict[str, _Tree] = {}
        self.is_leaf = False
        self.change: Transformation = None

    @classmethod
    def of(cls, changes: Mapping[str, Transformation]) -> _Tree:
        root = cls()
        for path, change in changes.items():
            node = root
            for step in P.steps(path):
                node = node.children.setdefault(step, cls())
            node.is_leaf, node.change = True, change
        return root


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _apply(change: Transformation, value: Column | None, scope: list) -> Column:
    if change is None:
        if value is None:
            raise AnalysisException("a field that does not exist needs a transformation")
        return value
    if isinstance(change, str):
        return F.col(change)
    if isinstance(change, Column):
        return change
    return box(change)(scope)


def _kind_of(kind: T.DataType | None, step: str) -> T.DataType | None:
    if step == P.ARRAY:
        return kind.elementType if isinstance(kind, T.ArrayType) else None
    return next((f.dataType for f in kind.fields if f.name == step), None) if isinstance(kind, T.StructType) else None


def _build(tree: _Tree, value: Column | None, kind: T.DataType | None, scope: list, keep: bool) -> Column:
    """The column of a node. ``keep``: fields of existing structs that the tree does not name stay."""
    if tree.is_leaf and not tree.children:
        return _apply(tree.change, value, scope)
    if set(tree.children) == {P.ARRAY}:
        inner, of = tree.children[P.ARRAY], _kind_of(kind, P.ARRAY)
        return F.transform(value, lambda x: _build(inner, x, of, [*scope, x], keep))
    if P.ARRAY in tree.children:
        raise AnalysisException("a field cannot be both a struct and an array")
    known = [f.name for f in kind.fields] if isinstance(kind, T.StructType) else []
    names = ([n for n in known if n not in tree.children] if keep else []) + list(tree.children)
    names = sorted(names, key=lambda n: known.index(n) if n in known else len(known)) if keep else names
    parts = []
    for name in names:
        below = value[name] if value is not None and name in known else None
        node = tree.children.get(name)
        parts.append((below if node is None else _build(node, below, _kind_of(kind, name), scope, keep)).alias(name))
    built = F.struct(*parts)
    return F.when(value.isNotNull(), built) if value is not None and known else built


def _check(changes: Mapping[str, Transformation], df: DataFrame | None) -> None:
    errors = []
    for path in changes:
        try:
            P.steps(path)
        except ValueError as e:
            errors.append(str(e))
    if df is not None and not errors:
        known = [f.name for f in flatten_schema(df.schema, keep_non_leaf_fields=True)]
        arrays = {k for k in known if k.endswith(P.ARRAY)}
        for path, change in changes.items():
            lost = next((a for a in P.array_prefixes(path) if a not in arrays), None)
            if lost:
                like = P.closest(lost, sorted(arrays))
                errors.append(f"Repeated field '{lost}' does not exist: Did you mean one of the following? {like}")
            elif change is None and path not in known:
                errors.append(f"Field '{path}' does not exist: Did you mean one of the following? {P.closest(path, known)}")
    if errors:
        raise AnalysisException("\n".join(errors))


def resolve(changes: Mapping[str, Transformation], df: DataFrame, keep: bool = False) -> list[Column]:
    """Columns that build the named fields, in the order of the paths."""
    _check(changes, df)
    tree = _Tree.of(changes)
    out = []
    for name, node in tree.children.items():
        kind = _kind_of(df.schema, name)
        out.append(_build(node, quoted(name) if kind is not None else None, kind, [df], keep).alias(name))
    return out


def select(df: DataFrame, changes: Mapping[str, Transformation]) -> DataFrame:
    """Only the given fields. A transformation is None (as it is), a column name, a Column, or a function.

    A function of n arguments gets the n innermost of: the DataFrame, then the element of each array on the path.
    """
    return df.select(*resolve(changes, df))


def with_fields(df: DataFrame, changes: Mapping[str, Transformation]) -> DataFrame:
    """All fields, with the given ones changed in place or added at the end of their struct."""
    built = dict(zip(_Tree.of(changes).children, resolve(changes, df, keep=True), strict=True))
    kept = [built.pop(c) if c in built else quoted(c) for c in df.columns]
    return df.select(*kept, *built.values())


def select_nested_columns(df: DataFrame, changes: Mapping[str, Transformation]) -> DataFrame:
    """Former name of select."""
    warnings.warn("select_nested_columns is now nested.select", DeprecationWarning, stacklevel=2)
    return select(df, changes)


def with_nested_columns(df: DataFrame, changes: Mapping[str, Transformation]) -> DataFrame:
    """Former name of with_fields."""
    warnings.warn("with_nested_columns is now nested.with_fields", DeprecationWarning, stacklevel=2)
    return with_fields(df, changes)


def show_resolved(changes: Mapping[str, Transformation]) -> str:
    """The function that ``select`` builds, as text."""
    _check(changes, None)

    def text(change: Transformation, value: str, scope: list[str]) -> str:
        if change is None:
            return value
        if isinstance(change, str):
            return f"f.col('{change}')"
        if isinstance(change, PrintableFunction):
            return change.show(scope[-1])
        return str(change) if isinstance(change, Column) else f"{change.__name__}({', '.join(scope)})"

    def show(tree: _Tree, value: str, scope: list[str]) -> str:
        if tree.is_leaf and not tree.children:
            return text(tree.change, value, scope)
        if P.ARRAY in tree.children:
            return f"f.transform({value}, lambda x: {show(tree.children[P.ARRAY], 'x', [*scope, 'x'])})"
        inner = ", ".join(f"{show(n, f'{value}[{k!r}]', scope)}.alias({k!r})" for k, n in tree.children.items())
        return f"f.struct({inner})"

    parts = (f"{show(n, f'x[{k!r}]', ['x'])}.alias({k!r})" for k, n in _Tree.of(changes).children.items())
    return f"lambda x: [{', '.join(parts)}]"


def _rebuild(value: Column, kind: T.DataType, change: Callable[[Column, T.DataType], Column | None], rename: Callable[[str], str]) -> Column | None:
    """The changed value, or None if nothing in it changes."""
    if isinstance(kind, T.StructType):
        parts = [(f, _rebuild(value[f.name], f.dataType, change, rename)) for f in kind.fields]
        if all(p is None and rename(f.name) == f.name for f, p in parts):
            return None
        built = F.struct(*[(value[f.name] if p is None else p).alias(rename(f.name)) for f, p in parts])
        return F.when(value.isNotNull(), built)
    if isinstance(kind, T.ArrayType):
        probe = _rebuild(F.lit(None).cast(kind.elementType), kind.elementType, change, rename)
        inner = value

        def each(x: Column) -> Column:
            new = _rebuild(x, kind.elementType, change, rename)
            return x if new is None else new

        if probe is not None:
            inner = F.transform(value, each)
        whole = change(inner, kind)
        return whole if whole is not None else (inner if probe is not None else None)
    return change(value, kind)


def build_from_schema(
    schema: T.StructType, change: Callable[[Column, T.DataType], Column | None] = lambda c, k: None, rename: Callable[[str], str] = lambda n: n
) -> list[Column]:
    """Columns that rebuild a schema with every scalar, array element and whole array offered to ``change``.

    ``change`` returns None to leave a value; structs are not offered. ``rename`` maps field names.
    """
    out = []
    for f in schema.fields:
        new = _rebuild(quoted(f.name), f.dataType, change, rename)
        out.append((quoted(f.name) if new is None else new).alias(rename(f.name)))
    return out


# Unnesting.


def _element(path: str, opened: str) -> Column:
    """A field by path, read from the elements of the exploded array ``opened`` or from the table's root."""
    rest = path[len(opened) :].lstrip(P.STRUCT) if opened else path
    names = [n for n in P.steps(rest) if n != P.ARRAY] if rest else []
    value = quoted(P.mangle(opened)) if opened else quoted(names.pop(0))
    for n in names:
        value = value[n]
    return value


def unnest_fields(df: DataFrame, paths: str | list[str], keep_fields: list[str] | None = None) -> dict[str, DataFrame]:
    """One table for each granularity of the given fields, arrays on the way exploded; rows of empty arrays go.

    Each table has the ``keep_fields`` it can reach and its own fields, with mangled names.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    keep = list(keep_fields or [])
    _check(dict.fromkeys([*wanted, *keep]), df)
    opened: dict[str, DataFrame] = {"": df}
    for path in wanted:
        for array in P.array_prefixes(path):
            if array not in opened:
                outer = P.granularity(array[:-1])
                opened[array] = opened[outer].select("*", F.explode(_element(array[:-1], outer)).alias(P.mangle(array)))
    out: dict[str, DataFrame] = {}
    for level in dict.fromkeys(P.granularity(p) for p in wanted):
        reach = [k for k in keep if level.startswith(P.granularity(k))]
        names = list(dict.fromkeys([*reach, *(p for p in wanted if P.granularity(p) == level)]))
        out[level] = opened[level].select(*[_element(n, P.granularity(n)).alias(P.mangle(n)) for n in names])
    return out


def unnest_field(df: DataFrame, path: str, keep_columns: list[str] | None = None) -> DataFrame:
    """The table of one field, with the columns to keep."""
    return unnest_fields(df, path, keep_columns)[P.granularity(path)]


def unnest_all_fields(df: DataFrame, keep_columns: list[str] | None = None) -> dict[str, DataFrame]:
    """One table for each granularity of the schema, by granularity; the root's is the empty string."""
    keep = list(keep_columns or [])
    return unnest_fields(df, [f for f in fields(df) if f not in keep], keep)
