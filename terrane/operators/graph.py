"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.operators.skew import attach
from terrane.session import cut, drop_path


#: So many edges are joined by one task in memory; larger graphs take star steps over all tasks.
LOCAL_EDGES = 200_000


def _pairs_schema(kind: str) -> str:
    return f"u {kind}, v {kind}"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition -> the same components as stars on their smallest node.

    Union-find on up to LOCAL_EDGES edges at a time: memory is bounded, and a hub's edges are rewired
    before they are shuffled.
    """
    parent: dict = {}
    held, kinds = 0, None

    def root(x):
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> Iterator[pa.RecordBatch]:
        nodes = list(parent)
        for i in range(0, len(nodes), 50_000):
            some = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, kinds), pa.array([root(x) for x in some], kinds)], names=["u", "v"])

    for batch in batches:
        kinds = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        held += batch.num_rows
        if held >= LOCAL_EDGES:
            yield from stars()
            parent.clear()
            held = 0
    if parent:
        yield from stars()


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """Per u: the smallest of u and its neighbours, and the number of edges."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step; edges are cut tables of distinct (u, v). The hub's edges never meet in one task."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = cut(_min_neighbour(both), "cc-min")
    joined = attach(both, near, "u", "n")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
    found = cut(out.filter("u <> v").distinct(), "cc-edges")
    drop_path(edges.sparkSession, near)
    return found


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(
    df: DataFrame, node_name: str = "node_id", connected_component_col_name: str = "connected_component_id", local_edges: int = LOCAL_EDGES
) -> DataFrame:
    """(node, smallest node of its component) for an edge table of two columns of one type, string or integer.

    Edges are first joined within each partition. If fewer than ``local_edges`` are left, one task joins them; else
    alternating large-star and small-star steps (2014) run until the edges stay the same, each a
    min-aggregation joined back, never an array of neighbours. A null endpoint links nothing; its partner
    stays as a component of one. Self-loops and repeated edges are fine; an empty table gives an empty result.
    """
    if len(df.columns) != 2:
        raise AssertionError(f"an edge table has two columns, not {len(df.columns)}")
    kinds = [f.dataType for f in df.schema.fields]
    integer = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if not (all(isinstance(k, T.StringType) for k in kinds) or all(isinstance(k, integer) for k in kinds)):
        raise AssertionError("both columns of an edge table must be strings, or both integers")
    kind = "string" if isinstance(kinds[0], T.StringType) else "bigint"
    left, right = (F.col(f"`{c}`").cast(kind) for c in df.columns)
    raw = df.select(left.alias("u"), right.alias("v"))
    raw = raw.select(F.coalesce("u", "v").alias("u"), F.coalesce("v", "u").alias("v")).filter("u IS NOT NULL")
    stars = cut(raw.mapInArrow(_forest, _pairs_schema(kind)), "cc-forest")
    if stars.count() < local_edges:
        whole = cut(stars.coalesce(1).mapInArrow(_forest, _pairs_schema(kind)), "cc-whole")
        drop_path(df.sparkSession, stars)
        return whole.select(F.col("u").alias(node_name), F.col("v").alias(connected_component_col_name))
    nodes = cut(stars.select("u").unionByName(stars.select(F.col("v").alias("u"))).distinct(), "cc-nodes")
    edges = cut(stars.filter("u <> v").distinct(), "cc-edges")
    drop_path(df.sparkSession, stars)
    before = _state(edges)
    while before[0]:
        bigger = _star(edges, large=True)
        drop_path(df.sparkSession, edges)
        edges = _star(bigger, large=False)
        drop_path(df.sparkSession, bigger)
        now = _state(edges)
        if now == before:
            break
        before = now
    named = nodes.join(edges, "u", "left")
    return named.select(
        F.col("u").alias(node_name), F.coalesce("v", "u").alias(connected_component_col_name)
    )
