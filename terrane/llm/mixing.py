"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). The flow routes each pattern's
words to the quotas of its sources; every further repetition of a pattern costs more, so repetition is spread where
it is cheapest. The patterns and sources, not the documents, reach the driver. Each pattern's flow is then turned
into documents along a seeded hash order: whole passes, and a last partial pass that ends at a cut found by
histograms of hash ranges, so no source is ever sorted or gathered in one task.

Cases. A null text has size 0 and is never taken; a null source is a source of its own, ranked last. Repeated ids
share their place in the order and are taken together. Empty tables give empty results. Other columns may have any
name and are passed on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.llm.common import few, free_names, word_count
from terrane.session import cut

#: Bits of the seeded order, and of one histogram level.
ORDER_BITS, LEVEL_BITS = 60, 10
#: Cost of a word in its first, second, ... use; convex.
REPEAT_COST = (1, 3)


class FlowNetwork:
    """Min-cost max-flow by successive shortest paths with potentials; costs must not be negative."""

    def __init__(self, nodes: int):
        self.arcs: list[list] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.out[a].append(len(self.arcs))
        self.arcs.append([b, capacity, cost])
        self.out[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def flow(self, arc: int) -> int:
        return self.arcs[arc + 1][1]

    def solve(self, start: int, end: int) -> int:
        n, total = len(self.out), 0
        potential = [0] * n
        while True:
            best: list[float] = [float("inf")] * n
            via, best[start], queue = [-1] * n, 0, [(0, start)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > best[a]:
                    continue
                for k in self.out[a]:
                    b, capacity, cost = self.arcs[k]
                    if capacity and (x := d + cost + potential[a] - potential[b]) < best[b]:
                        best[b], via[b] = x, k
                        heapq.heappush(queue, (x, b))
            if via[end] < 0:
                return total
            potential = [p + (int(d) if d < float("inf") else 0) for p, d in zip(potential, best, strict=True)]
            path, at = [], end
            while at != start:
                path.append(via[at])
                at = self.arcs[via[at] ^ 1][0]
            amount = min(self.arcs[k][1] for k in path)
            for k in path:
                self.arcs[k][1] -= amount
                self.arcs[k ^ 1][1] += amount
            total += amount


def fill_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess shared again by weight."""
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        open_ -= over
        left = total - sum(targets[i] for i in range(len(sizes)) if i not in open_)
    return targets


def route(patterns: dict[tuple, int], quotas: dict, costs: tuple = REPEAT_COST) -> dict[tuple, dict]:
    """Words of each pattern that go to each of its sources. patterns: sources -> words."""
    names, keys = list(quotas), list(patterns)
    at = {s: 2 + len(keys) + i for i, s in enumerate(names)}
    net = FlowNetwork(2 + len(keys) + len(names))
    links = {}
    for i, key in enumerate(keys):
        for cost in costs:
            net.arc(0, 2 + i, patterns[key], cost)
        for s in key:
            links[key, s] = net.arc(2 + i, at[s], len(costs) * patterns[key], 0)
    for s in names:
        net.arc(at[s], 1, quotas[s], 0)
    net.solve(0, 1)
    return {key: {s: net.flow(links[key, s]) for s in key} for key in keys}


@dataclass
class Mix:
    """What to take: per pattern the whole passes, the hash below which one more pass goes, and single fill-ups."""

    targets: dict = field(default_factory=dict)
    sizes: dict = field(default_factory=dict)
    passes: dict = field(default_factory=dict)
    cuts: dict = field(default_factory=dict)
    fills: dict = field(default_factory=dict)


def seeded_order(id_: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_), 64 - ORDER_BITS)


def _cuts(spark: SparkSession, rows: DataFrame, wanted: dict[tuple, int]) -> dict[tuple, int]:
    """Per pattern the hash below which the documents hold about ``wanted`` words, level by level."""
    state = {p: (0, need) for p, need in wanted.items()}  # start of the range, words still wanted from it
    done: dict[tuple, int] = {}
    shift = ORDER_BITS
    schema = "pattern string, first bigint, need bigint"
    while state and shift > 0:
        shift -= LEVEL_BITS
        ask = spark.createDataFrame([(p, first, need) for p, (first, need) in state.items()], schema)
        hits = rows.join(few(ask, len(state), _widest(state)), "pattern").filter(F.shiftright("h", shift + LEVEL_BITS) == F.shiftright("first", shift + LEVEL_BITS))
        cells = hits.groupBy("pattern", "need", F.shiftright("h", shift).alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("cell"))
        found = {r.pattern: r for r in cells.withColumn("upto", upto).filter("upto > need AND upto - words <= need").collect()}
        for p in list(state):
            first, need = state.pop(p)
            r = found.get(p)
            if r is None:  # all of the range is wanted
                done[p] = ((first >> (shift + LEVEL_BITS)) + 1) << (shift + LEVEL_BITS)
                continue
            need -= r.upto - r.words
            if r.n == 1 or shift == 0:
                done[p] = r.cell << shift  # the document that crosses is left to the fill-up
            else:
                state[p] = (r.cell << shift, need)
    return done


def _widest(patterns: Iterable[str]) -> int:
    """Bytes of the widest row that holds one of these patterns and some numbers."""
    return 64 + max((len(p.encode("utf-8", "surrogatepass")) for p in patterns), default=0)


def plan_mix(
    docs: DataFrame, members: Column, size: Column, id_: Column, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7
) -> tuple[Mix, DataFrame]:
    """The mix, and the table (pattern, h, size) it was made from. members: array of source names, null for none."""
    spark = docs.sparkSession
    rows = docs.select(
        F.to_json(F.struct(F.sort_array(F.array_distinct(members)).alias("s")), {"ignoreNullFields": "false"}).alias("pattern"),
        F.sort_array(F.array_distinct(members)).alias("sources"), seeded_order(id_, seed).alias("h"), size.alias("size"),
    )
    rows = cut(rows.select("pattern", "sources", "h", "size"), "mix-rows")
    seen = rows.groupBy("pattern", "sources").agg(F.sum("size").alias("words")).collect()
    names = sorted({s for r in seen for s in r.sources if s is not None}) + [None] * any(None in r.sources for r in seen)
    mix = Mix()
    mix.sizes = {s: sum(r.words for r in seen if s in r.sources) for s in names}
    total = sum(r.words for r in seen)
    shares = fill_targets([mix.sizes[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], share * total, most)
    mix.targets = dict(zip(names, shares, strict=True))
    patterns = {tuple(r.sources): r.words for r in seen}
    text = {tuple(r.sources): r.pattern for r in seen}
    flows = route(patterns, {s: round(t) for s, t in mix.targets.items()})
    partial = {}
    for key, by in flows.items():
        words, p = patterns[key], text[key]
        mix.passes[p], rest = divmod(sum(by.values()), words) if words else (0, 0)
        if rest:
            partial[p] = rest
    mix.cuts = _cuts(spark, rows, partial)
    if partial:
        ask = spark.createDataFrame([(p, mix.cuts[p], need) for p, need in partial.items()], "pattern string, cut bigint, need bigint")
        both = rows.join(few(ask, len(partial), _widest(partial)), "pattern").groupBy("pattern", "cut", "need").agg(F.sum(F.when(F.col("h") < F.col("cut"), F.col("size")).otherwise(0)).alias("got"))
        short = both.select("pattern", "cut", (F.col("need") - F.col("got")).alias("short")).filter("short > 0").collect()
        while short:  # the largest documents that still fit close the gap; each round takes one for each pattern
            ask = spark.createDataFrame([(r[0], r[1], r[2], sorted(mix.fills.get(r[0], []))) for r in short], "pattern string, cut bigint, short bigint, used array<bigint>")
            wide = _widest(r[0] for r in short) + 8 * max(len(mix.fills.get(r[0], [])) for r in short)
            fit = rows.join(few(ask, len(short), wide), "pattern").filter("h >= cut AND size <= short AND size > 0 AND NOT array_contains(used, h)")
            best = fit.groupBy("pattern", "cut", "short").agg(F.max(F.struct("size", (-F.col("h")).alias("h"))).alias("b")).collect()
            for r in best:
                mix.fills.setdefault(r.pattern, set()).add(-r.b.h)
            short = [(r.pattern, r.cut, r.short - r.b.size) for r in best if r.short > r.b.size]
    return mix, rows


def apply_mix(docs: DataFrame, mix: Mix, members: Column, id_: Column, seed: int = 7, copies: str = "__copies") -> DataFrame:
    """``docs`` with a column ``copies``, how often the mix takes the document.

    The plan has a row for each pattern and is broadcast if these are small, so documents stay where they are.
    """
    spark, names = docs.sparkSession, docs.columns
    own, place, key, passes, below, fills = free_names([*names, copies], "own", "place", "key", "passes", "below", "fills")
    pattern = F.to_json(F.struct(F.sort_array(F.array_distinct(members)).alias("s")), {"ignoreNullFields": "false"})
    plan = [(p, n, mix.cuts.get(p, 0), sorted(mix.fills.get(p, []))) for p, n in mix.passes.items()]
    wide = _widest(mix.passes) + 8 * max((len(r[3]) for r in plan), default=0)
    plan = few(spark.createDataFrame(plan, f"{key} string, {passes} bigint, {below} bigint, {fills} array<bigint>"), len(plan), wide)
    joined = docs.withColumns({own: pattern, place: seeded_order(id_, seed)}).join(plan, F.col(own) == F.col(key), "left")
    more = (F.col(place) < F.col(below)) | F.array_contains(fills, F.col(place))
    return joined.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(passes) + more.cast("bigint"), F.lit(0)).alias(copies))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows that the mix takes, a repeated document as repeated rows, all columns kept."""
    members, id_, size = F.array(F.col(f"`{source_col}`")), F.col(f"`{id_col}`"), word_count(F.col(f"`{text_col}`"))
    mix, _ = plan_mix(docs, members, size, id_)
    copies, copy = free_names(docs.columns, "copies", "copy")
    taken = apply_mix(docs, mix, members, id_, copies=copies).filter((F.col(copies) > 0) & (size > 0))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    members, id_ = F.array("source"), F.col("doc_id")
    docs = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mix, _ = plan_mix(docs, members, F.col("size"), id_)
    rows = [(s, mix.sizes[s], float(mix.targets[s])) for s in mix.targets]
    per_source = few(spark.createDataFrame(rows, "name string, source_size bigint, target double"), len(rows), _widest(s or "" for s in mix.targets))
    out = apply_mix(docs, mix, members, id_).join(per_source, F.col("source").eqNullSafe(F.col("name")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("__copies")).alias("taken"))
