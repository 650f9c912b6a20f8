"""Keys of a diff: finding them, and guarding against those that are far from unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.errors import CombinatorialExplosionError, DataframeComparatorException
from terrane.operators.nested import quoted
from terrane.plans.types import FLOATS, INTEGERS

#: Share of distinct values, in per cent, from which a column may be a key; growth at which a diff is refused.
DISTINCT_PERCENT, MOST_GROWTH = 90, 2.0


def growth_estimate(df: DataFrame, keys: list[str]) -> float:
    """Rows that a self-join on the keys gives for each row; nulls count as a value, an empty table gives 1."""
    sizes = df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    total, square = sizes.agg(F.sum("__n"), F.sum(F.col("__n").cast("double") * F.col("__n"))).first()
    return round(square / total, 2) if total else 1.0


def candidates(left: DataFrame, right: DataFrame) -> list[str]:
    """Common scalar columns with nearly as many values as rows on either side: one pass over each table, with sketches."""
    kinds = (T.StringType, *INTEGERS, *FLOATS)
    names = [f.name for f in left.schema.fields if isinstance(f.dataType, kinds) and f.name in right.columns and isinstance(right.schema[f.name].dataType, kinds)]
    if not names:
        return []
    found: set[str] = set()
    for df in (left, right):
        row = df.agg(F.count(F.lit(1)), *[F.hll_sketch_estimate(F.hll_sketch_agg(quoted(n).cast("string"), F.lit(14))) for n in names]).first()
        found |= {n for n, d in zip(names, row[1:], strict=True) if row[0] and (d or 0) * 100 / row[0] > DISTINCT_PERCENT}
        if not row[0]:
            found |= set(names[:1])
    return [n for n in names if n in found]


def infer_key(left: DataFrame, right: DataFrame) -> tuple[str, float]:
    """The candidate with the least growth, averaged over both sides; the first of equals."""
    found = {n: (growth_estimate(left, [n]) + growth_estimate(right, [n])) / 2 for n in candidates(left, right)}
    if not found:
        raise DataframeComparatorException("no column could be found to join the tables on: please give join_cols")
    return min(found.items(), key=lambda x: x[1])


def check_growth(left: DataFrame, right: DataFrame, keys: list[str]) -> float:
    """Refuses keys that would blow up the join; warns about keys that are not unique."""
    growth = max(growth_estimate(left, keys), growth_estimate(right, keys))
    if growth >= MOST_GROWTH:
        raise CombinatorialExplosionError(f"joining on {keys} would multiply rows by {growth}: please give join_cols that tell rows apart")
    if growth > 1.0:
        print(f"WARNING: join_cols {keys} are not unique: rows are multiplied by {growth}")
    return growth
