"""The diff itself: one null-safe full join for each granularity."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.diff.keys import check_growth, infer_key
from terrane.diff.result import EXISTS, IS_EQUAL, DiffResult
from terrane.diff.schema_diff import LEFT, RIGHT, SAME, diff_schemas
from terrane.errors import DataframeComparatorException
from terrane.operators.nested import quoted, unnest_fields
from terrane.operators.transformations import flatten, harmonize_dataframes, sort_all_arrays
from terrane.plans import paths as P


def _without_null_arrays(df: DataFrame) -> DataFrame:
    """Null arrays as empty ones, for tables whose store does not tell them apart."""
    return df.select(*[F.coalesce(quoted(f.name), F.array().cast(f.dataType)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else quoted(f.name) for f in df.schema.fields])


def build_diff(left: DataFrame, right: DataFrame, keys: list[str], distinguish_null_arrays: bool = False) -> DataFrame:
    """Both tables side by side: for each column a struct of values, equality and presence; keys are null-safe."""
    names = [*left.columns, *(c for c in right.columns if c not in left.columns)]
    a, b = (sort_all_arrays(x) for x in harmonize_dataframes(left, right, keep_missing_columns=True))
    if not distinguish_null_arrays:
        a, b = _without_null_arrays(a), _without_null_arrays(b)
    l, r = (df.select(F.struct(*[quoted(c) for c in df.columns]).alias(side)) for df, side in ((a, "l"), (b, "r")))
    on = functools.reduce(Column.__and__, [F.col("l")[k].eqNullSafe(F.col("r")[k]) for k in keys])
    joined = l.join(r, on, "full")
    has_left, has_right = F.col("l").isNotNull(), F.col("r").isNotNull()
    out, equal = [], []
    for c in names:
        mine = F.col("l")[c] if c in a.columns else F.lit(None).cast(b.schema[c].dataType)
        yours = F.col("r")[c] if c in b.columns else F.lit(None).cast(a.schema[c].dataType)
        in_left, in_right = (has_left if c in a.columns else F.lit(False)), (has_right if c in b.columns else F.lit(False))
        x, y = mine, yours
        if c in a.columns and c in b.columns and a.schema[c].dataType != b.schema[c].dataType:
            x, y = F.to_json(mine), F.to_json(yours)
        same = in_left & in_right & x.eqNullSafe(y)
        if c in a.columns and c in b.columns:
            equal.append(same)
        out.append(F.struct(mine.alias("left_value"), yours.alias("right_value"), same.alias("is_equal"), in_left.alias("exists_left"), in_right.alias("exists_right")).alias(c))
    every = functools.reduce(Column.__and__, equal, F.lit(True))
    return joined.select(*out, F.struct(has_left.alias("left_value"), has_right.alias("right_value")).alias(EXISTS), (has_left & has_right & every).alias(IS_EQUAL))


def _check_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    for df, side in ((left, "left"), (right, "right")):
        try:
            unnest_fields(df, keys)
        except Exception as e:
            raise DataframeComparatorException(f"join_cols {keys} do not fit the {side} table: {e}") from e


def compare_dataframes(left: DataFrame, right: DataFrame, join_cols: list[str] | None = None, distinguish_null_arrays: bool = False) -> DiffResult:
    """Compare two tables by key. Keys inside arrays open these arrays, and give a diff for each granularity.

    Without ``join_cols`` one column is looked for that tells rows apart.
    """
    print("\nComparing two tables ...")
    flat_left = flat_right = None
    if not join_cols:
        print("No join_cols given: looking for a column that tells rows apart on both sides")
        flat_left, flat_right = (flatten(df, P.STRUCT_NAME) for df in (left, right))
        name, _ = infer_key(flat_left, flat_right)
        join_cols = [P.unmangle(name)]
        print(f"Chosen column: {join_cols[0]}")
        how = "inferred"
    else:
        _check_keys(left, right, join_cols)
        how = "provided"
    schema = diff_schemas(left.schema, right.schema, join_cols)
    mine = [n for n, w in schema.column_names_diff.items() if w in (SAME, LEFT)]
    yours = [n for n, w in schema.column_names_diff.items() if w in (SAME, RIGHT)]
    lefts, rights = unnest_fields(left, mine, join_cols), unnest_fields(right, yours, join_cols)
    shards = {}
    for level in [x for x in lefts if x in rights]:
        keys = [P.mangle(k) for k in join_cols if level.startswith(P.granularity(k))]
        if not keys or not set(keys) <= set(lefts[level].columns) & set(rights[level].columns):
            continue
        shown = [P.unmangle(k) for k in keys]
        print(f"Joining both tables on the {how} column{'s' if len(shown) > 1 else ''}: {shown if len(shown) > 1 else shown[0]}")
        check_growth(lefts[level], rights[level], keys)
        order = [P.mangle(n) for n in schema.column_names if P.mangle(n) in {*lefts[level].columns, *rights[level].columns}]
        a, b = (df.select(*[quoted(c) for c in order if c in df.columns]) for df in (lefts[level], rights[level]))
        shards[level] = build_diff(a, b, keys, distinguish_null_arrays)
    return DiffResult(schema, shards, list(join_cols))
