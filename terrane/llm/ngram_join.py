"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), and its connected documents.

A document is the set of hashes of its distinct word shingles; equal sets are one node. Two nodes can reach the
similarity only if they share one of the first tokens of both, in any order common to all documents; tokens that are
frequent in the corpus go last. Postings of these first tokens are dealt out by token, and each block of nodes with a
token in common is represented by a pivot, the node whose other tokens are least rare. Pivots query inverted indexes
over their candidates: DivideSkip merges the short lists with a heap that skips, probes the long ones by binary
search, and keeps nodes that reach the overlap T. Links join nodes into components.

No group is expanded into all its pairs: a pair of one block is looked at again only while its nodes are still in
different components, first against further pivots. What is left in the end is dealt out in tiles of TILE_ROWS nodes
with their sketches; a task compares two tiles and emits only pairs of different components whose sketches, sizes and
positions allow a link. So no link between components is lost, whatever the groups look like.

Node and token are 64-bit hashes: among n distinct texts about n^2 / 2^65 pairs are confused.

Postings are sent in PASSES parts, each from a pass over the texts, and written tables are deleted once they are read,
which bounds the disk. The driver holds the tokens that go last, at most MOST_COMMON of them: any order common to all
documents gives the same links.

Cases. Null and empty texts have empty sets and link with nothing, as do rows with a null id (their component is
null). Each row is a document: rows with a repeated id and different texts may lie in different components, and equal
texts are in one. Texts are read whole. Other columns may have any name; empty tables give empty results.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import BASE, BROADCAST_BYTES, few, free_names, keep_without, mix, small_batches, tidy, tidy_group, word_hashes
from terrane.operators.graph import connected_components
from terrane.operators.skew import attach
from terrane.session import cut, drop_path

WIDTH, PERCENT = 5, 75
#: Tokens in more than 1/COMMON of the documents go last; there are at most COMMON times the mean set size of them.
COMMON = 1000
#: Tokens that go last, at most.
MOST_COMMON = 1_000_000
#: Postings and set members that one task should hold, nodes of a tile, and passes over the texts for postings.
TASK_POSTINGS, TASK_TOKENS, TASK_MEMBERS, TILE_ROWS, PASSES = 250_000, 1_000_000, 2_000, 2_000, 3
#: The constant of DivideSkip's rule for the number of long lists.
MU = 0.0085
#: Text bytes that are hashed at a time.
CHUNK_BYTES = 1 << 18


def _sequence(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out *= np.uint64(BASE)
        out ^= out >> np.uint64(29)
        out += h[k : k + n]
    return mix(out + np.uint64(width))


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles, lower-cased A to Z; whole if shorter."""
    group: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        group.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            data = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
            start, _, words = word_hashes(data)
            bound = np.searchsorted(start, np.cumsum([0, *(len(g) + 1 for g in group)]))
            runs = _sequence(words, width) if len(words) >= width else np.zeros(0, np.uint64)
            for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                if b - a >= width:
                    x = np.sort(runs[a : b - width + 1])
                    yield x[np.concatenate(([True], x[1:] != x[:-1]))]
                else:
                    yield _sequence(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)
            group, size = [], 0


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return next(shingle_sets([text], width))


def node_of(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))


def needed(a, b):
    """Least overlap of sets of sizes a and b that reaches the similarity."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def odd_sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens in each of about 2n cells: two sets differ in at least as many tokens as their sketches in bits."""
    bits = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    flips = np.bincount((tokens >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def may_link(n1: int, sketch1: bytes, n2: int, sketch2: bytes) -> bool:
    """False only for sets below the similarity. A larger sketch is folded to the smaller one's cells."""
    a, b = int.from_bytes(sketch1, "little"), int.from_bytes(sketch2, "little")
    if len(sketch1) < len(sketch2):
        a, b, sketch1, sketch2 = b, a, sketch2, sketch1
    bits, least = 8 * len(sketch1), 8 * len(sketch2)
    while bits > least:
        bits //= 2
        a = (a >> bits) ^ (a & ((1 << bits) - 1))
    return (a ^ b).bit_count() <= n1 + n2 - 2 * needed(n1, n2)


def _refute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [may_link(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("qn", "qs", "mn", "ms")), strict=True)]
        yield batch.select(["q", "m"]).filter(pa.array(keep, pa.bool_()))


def _fold(words: np.ndarray, cells: int) -> np.ndarray:
    """Rows of 64-bit words of sketches, folded to that many words."""
    while words.shape[1] > cells:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """Pairs of two tiles of one block (or within one tile) that may link and lie in different components."""
    low, high = key[1].as_py(), key[2].as_py()
    node, n, pos, label, tile = (table.column(c).to_numpy() for c in ("node", "n", "pos", "label", "tile"))
    sketches = table.column("sketch").to_pylist()
    cells = np.array([len(x) // 8 for x in sketches], np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for width in np.unique(cells).tolist():  # sets that can link have sketches of one width or of neighbours
        mine = np.flatnonzero((cells == width) & (tile == low))
        near = np.flatnonzero(((cells == width) | (cells == 2 * width) | (2 * cells == width)) & (tile == high))
        if not len(mine) or not len(near):
            continue
        least = np.minimum(cells[near], width)
        for c in np.unique(least).tolist():
            at = near[least == c]
            left = _fold(np.frombuffer(b"".join(sketches[i] for i in mine), np.uint64).reshape(len(mine), -1), c)
            right = np.concatenate([_fold(np.frombuffer(sketches[i], np.uint64).reshape(1, -1), c) for i in at])
            for i, row in zip(mine, left, strict=True):
                ok = (label[at] != label[i]) & (node[at] > node[i] if low == high else True)
                need = needed(n[i], n[at])
                ok &= np.minimum(n[i] - pos[i], n[at] - pos[at]) >= need
                j = np.flatnonzero(ok)
                if len(j):
                    differ = np.bitwise_count(right[j] ^ row).sum(axis=1, dtype=np.int64)
                    j = j[differ <= n[i] + n[at[j]] - 2 * need[j]]
                    found.append((np.full(len(j), node[i]), node[at[j]]))
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table({"q": np.minimum(a, b), "m": np.maximum(a, b)})


# Pass 1: sizes, sketches, nodes, and tokens that are frequent within a few thousand texts.


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "mark", "n", "node", "sketch", "token", "df"]
    sets: dict[int, np.ndarray] = {}
    held = 0

    def frequent() -> pa.RecordBatch:
        token, df = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        often = df >= max(8, len(sets) // COMMON)
        some = pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([some, some, some, some, pa.nulls(len(some), pa.binary()), pa.array(token[often].view(np.int64)), pa.array(df[often])], names=names)

    for batch in batches:
        ids, sizes, nodes, sketches = [], [], [], []
        for doc, tokens in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist()), strict=True):
            node = node_of(tokens) if len(tokens) else None
            ids.append(doc)
            sizes.append(len(tokens))
            nodes.append(node)
            sketches.append(odd_sketch(tokens) if len(tokens) else None)
            if node is not None and node not in sets:
                sets[node] = tokens
                held += len(tokens)
        blank = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary()), blank, blank], names=names)
        if held > 1_000_000:
            yield frequent()
            sets, held = {}, 0
    if sets:
        yield frequent()


# Pass 2: postings of the first tokens.


def first_tokens(tokens: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The prefix of a set: rare tokens by hash, then common ones from the rarest on."""
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        late = common[at] == tokens
        if late.any():
            tokens = np.concatenate([tokens[~late], tokens[late][np.argsort(place[at[late]], kind="stable")]])
    return tokens[: prefix_length(len(tokens))]


def _post(told, buckets: int, turn: int):
    """Postings of the buckets of one pass, packed by bucket. told: the common tokens, their order and their salts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, place, salts = told.value
        for batch in batches:
            seen: set[int] = set()
            parts: list[tuple[np.ndarray, int, int]] = []
            for tokens in shingle_sets(batch.column(0).to_pylist()):
                if not len(tokens) or (node := node_of(tokens)) in seen:
                    continue
                seen.add(node)
                parts.append((first_tokens(tokens, common, place), node, len(tokens)))
            if not parts:
                continue
            counts = np.array([len(p[0]) for p in parts])
            token = np.concatenate([p[0] for p in parts])
            node = np.repeat(np.array([p[1] for p in parts], np.int64), counts)
            size = np.repeat(np.array([p[2] for p in parts], np.int64), counts)
            position = np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts)
            salt = np.zeros(len(token), np.uint64)
            if len(common):
                at = np.minimum(np.searchsorted(common, token), len(common) - 1)
                hot = (common[at] == token) & (salts[at] > 1)
                salt[hot] = mix(node[hot].view(np.uint64)) % salts[at[hot]].astype(np.uint64)
            bucket = (mix(token + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
            mine = np.flatnonzero(bucket % PASSES == turn)
            if not len(mine):
                continue
            order = mine[np.argsort(bucket[mine], kind="stable")]
            cells = np.empty((4, len(order)), np.int64)
            cells[0], cells[1], cells[2], cells[3] = token[order].view(np.int64), node[order], size[order], position[order]
            found, start = np.unique(bucket[order], return_index=True)
            ends = [*start[1:], len(order)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array([pack(cells[:, a:b]) for a, b in zip(start, ends, strict=True)], pa.binary())], names=["bucket", "cells"]
            )

    return run


def pack(cells: np.ndarray) -> bytes:
    """Token and node in 8 bytes, size and position in 4."""
    return cells[:2].tobytes() + cells[2:].astype(np.int32).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // 24
    wide = np.frombuffer(blob, np.int64, 2 * n).reshape(2, n)
    return np.concatenate([wide, np.frombuffer(blob, np.int32, 2 * n, 16 * n).reshape(2, n).astype(np.int64)])


def band(size: np.ndarray) -> np.ndarray:
    """Sizes that can reach the similarity are in one band or in neighbours."""
    return np.floor(np.log(np.maximum(size, 1)) / math.log(100 / PERCENT) + 1e-9).astype(np.int64)


BLOCK_DDL = "kind int, a bigint, b bigint, n bigint, pos bigint"


def _blocks(salted: np.ndarray):
    """Pairs with pivots and how often they met (kind 0: pivot, node), and blocks that these may not settle (kind 1: block, node).

    A salted token has only a part of its block here; all its postings go on under one block.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cells = np.concatenate([unpack(b) for b in table.column("cells").to_pylist()], axis=1)
        cells = np.unique(cells, axis=1) if table.num_rows > 1 else cells[:, np.lexsort(cells[::-1])]
        token, node, size, pos = cells
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        df = np.diff(np.append(first, len(token)))
        keep = np.repeat(df > 1, df) | np.isin(token, salted)
        token, node, size, pos = token[keep], node[keep], size[keep], pos[keep]
        for _ in range(3):
            keep = has_partner(token, size, pos) | np.isin(token, salted)
            token, node, size, pos = token[keep], node[keep], size[keep], pos[keep]
        order = np.lexsort((node, pos, band(size), token))
        token, node, size, pos = token[order], node[order], size[order], pos[order]
        a, b, group, counts = pivot_pairs(token, node, size, pos)
        # Blocks of three and more; one block for tokens with the same nodes.
        number = np.cumsum(np.concatenate(([0], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        total = np.bincount(number) if len(number) else np.zeros(0, np.int64)
        apart = np.isin(token, salted)
        large = (total[number] > 2 if len(number) else np.zeros(0, bool)) | apart
        sign = np.zeros(len(total), np.uint64)
        np.add.at(sign, number, mix(node.view(np.uint64)))
        block = np.where(apart, mix(token.view(np.uint64)).view(np.int64), sign.view(np.int64)[number] if len(number) else token)[large]
        rows = np.stack([block, node[large], size[large], pos[large]])
        if rows.shape[1]:
            rows = rows[:, np.lexsort((rows[3], rows[1], rows[0]))]
            once = np.concatenate(([True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])))
            rows = rows[:, once]
        pairs, often = np.unique(np.stack([a, b]), axis=1, return_counts=True) if len(a) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        n, m = pairs.shape[1], rows.shape[1]
        return pa.table(
            {
                "kind": pa.array(np.repeat([0, 1], [n, m]).astype(np.int32)), "a": np.concatenate([pairs[0], rows[0]]), "b": np.concatenate([pairs[1], rows[1]]),
                "n": np.concatenate([often, rows[2]]), "pos": np.concatenate([np.zeros(n, np.int64), rows[3]]),
            }
        )

    return run


def has_partner(token: np.ndarray, size: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether a posting's block has another of a size that its own size and position allow to link."""
    if not len(token):
        return np.zeros(0, bool)
    block = np.unique(token, return_inverse=True)[1].astype(np.int64) << 32
    order = np.sort(block + size)
    least = -(-PERCENT * size // 100)
    most = np.maximum((100 + PERCENT) * (size - pos) // PERCENT - size, 0)
    found = np.searchsorted(order, block + most, "right") - np.searchsorted(order, block + least, "left")
    return found - ((least <= size) & (size <= most)) > 0


def possible(n1, p1, n2, p2):
    """Whether sizes and positions of a common token allow the similarity."""
    return np.minimum(n1 - p1, n2 - p2) >= needed(n1, n2)


def pivot_pairs(block, node, size, pos):
    """Pairs (pivot, node) of arrays sorted by (block, band, pos, node): each node with the pivots of its own and the next bands."""
    if not len(block):
        e = np.zeros(0, np.int64)
        return e, e, e, e
    level = band(size)
    first = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (level[1:] != level[:-1]))))
    counts = np.diff(np.append(first, len(block)))
    group = np.repeat(np.arange(len(first)), counts)
    out = []
    for step in (0, 1, -1):
        other = group + step
        ok = (other >= 0) & (other < len(first))
        pivot = first[np.where(ok, other, 0)]
        ok &= (block[pivot] == block) & (level[pivot] == level + step) & (node[pivot] != node)
        ok &= possible(size[pivot], pos[pivot], size, pos)
        out.append((node[pivot[ok]], node[ok]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), group, counts


# Pass 3: T-occurrence search.


class InvertedIndex:
    """Sorted lists of members by token."""

    def __init__(self, sets: list[np.ndarray]):
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.members = member[order]
        self.tokens, self.start = np.unique(tokens[order], return_index=True)
        self.end = np.append(self.start[1:], len(tokens))

    def lists(self, tokens: np.ndarray) -> list[list[int]]:
        if not len(self.tokens):
            return []
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        at = at[self.tokens[at] == tokens]
        return [self.members[a:b].tolist() for a, b in zip(self.start[at], self.end[at], strict=True)]


def divide_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Members that occur in at least ``least`` of the sorted lists, with their exact number of occurrences."""
    found: dict[int, int] = {}
    if least < 1 or len(lists) < least:
        return found
    lists = sorted(lists, key=len, reverse=True)
    n_long = min(int(least / (MU * math.log2(len(lists[0]) + 1) + 1)), least - 1, len(lists) - 1)
    long_, short = lists[:n_long], lists[n_long:]
    threshold = least - n_long
    heap = [(x[0], i) for i, x in enumerate(short)]
    heapq.heapify(heap)
    at = [0] * len(short)
    while len(heap) >= threshold:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= threshold:
            count = len(popped)
            for x in long_:
                k = bisect.bisect_left(x, top)
                count += k < len(x) and x[k] == top
            if count >= least:
                found[top] = count
            target = top + 1
        else:  # what is popped next cannot reach the threshold before the member that then stands on top
            while heap and len(popped) < threshold - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            target = max(heap[0][0], top + 1)
        for i in popped:
            k = at[i] = bisect.bisect_left(short[i], target, at[i])
            if k < len(short[i]):
                heapq.heappush(heap, (short[i][k], i))
    return found


def _search(key: tuple, table: pa.Table) -> pa.Table:
    """Links (a < b) between the queries and the members of one task."""
    nodes, blobs, asks = (table.column(c).to_pylist() for c in ("node", "tokens", "asks"))
    members = {n: np.frombuffer(b, np.uint64) for n, b, q in zip(nodes, blobs, asks, strict=True) if not q}
    queries = {n: np.frombuffer(b, np.uint64) for n, b, q in zip(nodes, blobs, asks, strict=True) if q}
    names, sets = list(members), list(members.values())
    index = InvertedIndex(sets)
    links: set[tuple[int, int]] = set()
    for q, tokens in queries.items():
        for m, overlap in divide_skip(index.lists(tokens), -(-PERCENT * len(tokens) // 100)).items():
            if names[m] != q and 100 * overlap >= PERCENT * (len(tokens) + len(sets[m]) - overlap):
                links.add((min(q, names[m]), max(q, names[m])))
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
            sets = list(shingle_sets(part.column(0).to_pylist()))
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            found = pa.RecordBatch.from_arrays([part.column(1), part.column(2), nodes, pa.array([s.tobytes() for s in sets], pa.binary())], names=["bucket", "asks", "node", "tokens"])
            yield found.filter(pc.equal(nodes, part.column(3)))  # an id may have several texts


class NgramJoin:
    """One self-join of a table of (doc_id, text)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        small_batches(self.spark)
        text = F.col(f"`{text_col}`").cast("string")
        self.docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text"), text_mark(text).alias("mark"))
        self.live = self.docs.filter("doc_id IS NOT NULL")
        seen = cut(self.docs.mapInArrow(tidy(_describe), "doc_id bigint, mark bigint, n bigint, node bigint, sketch binary, token bigint, df bigint"), "ngram-seen")
        rows = seen.filter("token IS NULL")
        nodes = rows.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node")
        self.nodes = cut(nodes.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "ngram-nodes")
        self.count, postings, tokens = self.nodes.agg(F.count("*"), F.sum(F.expr(f"n - ceil({PERCENT} * n / 100) + 1")), F.sum("n")).first()
        self.postings, self.tokens = int(postings or 0), int(tokens or 0)
        floor = max(8, self.count // COMMON)
        often = seen.filter("token IS NOT NULL").groupBy("token").agg(F.sum("df").alias("df")).filter(F.col("df") >= floor)
        often = often.orderBy(F.desc("df"), "token").limit(MOST_COMMON).toPandas()
        often = often.assign(token=often.token.to_numpy(np.int64).view(np.uint64)).sort_values("token")
        self.common, df = often.token.to_numpy(np.uint64), often.df.to_numpy(np.int64)
        self.place = np.argsort(np.argsort(df, kind="stable"), kind="stable")
        self.salts = np.maximum(1, -(-df // TASK_POSTINGS))
        self.sets = cut(rows.select("doc_id", "mark", "n", "node"), "ngram-sets")
        drop_path(self.spark, seen)

    def candidates(self) -> list[DataFrame]:
        """Pivot pairs and open blocks, a table for each pass."""
        buckets = max(1, -(-self.postings // TASK_POSTINGS), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        salted, found = self.common[self.salts > 1].view(np.int64), []
        told = self.spark.sparkContext.broadcast((self.common, self.place, self.salts))  # at most 24 bytes for each of MOST_COMMON tokens
        for turn in range(PASSES):
            blobs = self.live.select("text").mapInArrow(tidy(_post(told, buckets, turn)), "bucket bigint, cells binary")
            found.append(cut(blobs.groupBy("bucket").applyInArrow(tidy_group(_blocks(salted)), BLOCK_DDL), "ngram-blocks"))
        told.unpersist()
        return found

    def search(self, pairs: DataFrame) -> DataFrame:
        """Links found by queries of column q against candidates m; pairs is a cut table of distinct plausible rows."""
        per_q = cut(pairs.groupBy("q").agg(F.count("*").alias("n")), "ngram-queries")
        chunked = per_q.withColumn("chunks", F.ceil(F.col("n") / TASK_MEMBERS))
        sized = self.nodes.select("node", F.col("n").alias("size"), "first_id")
        dealt = cut(attach(pairs, chunked, "q", "n").withColumn("deal", F.xxhash64("q", F.pmod(F.xxhash64("m"), "chunks"))).select("deal", "q", "m"), "ngram-dealt")
        roles = dealt.select("deal", F.col("m").alias("node"), F.lit(False).alias("asks")).unionByName(dealt.select("deal", F.col("q").alias("node"), F.lit(True).alias("asks")))
        roles = cut(roles.distinct().join(sized, "node"), "ngram-roles")
        tokens, count = roles.agg(F.sum("size"), F.count("*")).first()
        buckets = max(1, -(-(tokens or 0) // TASK_TOKENS), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        asked = roles.select(F.col("first_id").alias("doc_id"), "node", F.pmod("deal", F.lit(buckets)).alias("bucket"), "asks").distinct()
        asked = F.broadcast(asked) if count * 32 <= BROADCAST_BYTES else asked  # else texts are shuffled by id
        sets = self.live.join(asked, "doc_id").select("text", "bucket", "asks", F.col("node").alias("wanted")).mapInArrow(tidy(_sets), "bucket bigint, asks boolean, node bigint, tokens binary")
        links = cut(sets.groupBy("bucket").applyInArrow(tidy_group(_search), "a bigint, b bigint").distinct(), "ngram-links")
        self._drop(per_q, dealt, roles)
        return links

    def _drop(self, *tables: DataFrame) -> None:
        for t in tables:
            drop_path(self.spark, t)

    def _plausible(self, pairs: DataFrame) -> DataFrame:
        """The pairs that their sketches do not rule out; sketches are a thirtieth of the sets."""
        per_q = pairs.groupBy("q").agg(F.count("*").alias("uses")).join(self.nodes.select(F.col("node").alias("q"), F.col("n").alias("qn"), F.col("sketch").alias("qs")), "q")
        per_q = cut(per_q, "ngram-sketches")
        other = self.nodes.select(F.col("node").alias("m"), F.col("n").alias("mn"), F.col("sketch").alias("ms"))
        both = attach(pairs.select("q", "m"), per_q, "q", "uses", "inner").join(other, "m")
        found = cut(both.select("q", "m", "qn", "qs", "mn", "ms").mapInArrow(_refute, "q bigint, m bigint"), "ngram-plausible")
        self._drop(per_q)
        return found

    def _link(self, pairs: DataFrame, labels: DataFrame | None, sure: bool = False) -> DataFrame:
        """Components after the search of pairs, a written table that is deleted; ``sure`` pairs have passed their sketches."""
        some = pairs if sure else self._plausible(pairs)
        links = self.search(some)
        merged = self.merge(labels, links)
        self._drop(links, *([] if sure else [some]))
        if labels is not None and merged is not labels:
            self._drop(labels)
        return merged

    def merge(self, labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """(node, label) after more links: only what still differs is joined anew."""
        if labels is None:
            return cut(connected_components(links.select("a", "b"), "node", "label"), "ngram-labels")
        a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        edges = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct()
        edges = cut(edges, "ngram-edges")
        if edges.isEmpty():
            self._drop(edges)
            return labels
        higher = cut(connected_components(edges, "label", "above"), "ngram-higher")
        every = labels.unionByName(higher.select(F.col("label").alias("node"), "label").join(labels.select("node"), "node", "left_anti"))
        merged = cut(every.join(higher, "label", "left").select("node", F.coalesce("above", "label").alias("label")), "ngram-labels")
        self._drop(edges, higher)
        return merged

    def _sized(self, df: DataFrame) -> DataFrame:
        """Broadcast if its counted rows are few."""
        return F.broadcast(df) if df.count() * 24 <= BROADCAST_BYTES else df

    def _apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs whose nodes are in different components so far."""
        q, m = (self._sized(labels).select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "qm")
        told = pairs.join(q, "q", "left").join(m, "m", "left")
        return told.filter(F.coalesce("lq", "q") != F.coalesce("lm", "m")).select("q", "m")

    def components(self, rounds: int = 3, eager: int = 8) -> DataFrame:
        """(node, label) for nodes that link with others."""
        parts = self.candidates()
        found = functools.reduce(DataFrame.unionAll, parts)
        pairs = cut(found.filter("kind = 0").groupBy(F.col("a").alias("q"), F.col("b").alias("m")).agg(F.sum("n").alias("met")), "ngram-pairs")
        open_ = found.filter("kind = 1").groupBy(F.col("a").alias("block"), F.col("b").alias("node")).agg(F.first("n").alias("n"), F.min("pos").alias("pos"))
        open_ = cut(open_, "ngram-open")
        self._drop(*parts)
        # First each node against the pivot it met most; then the other pivots, where that has not joined them.
        best = pairs.groupBy("m").agg(F.max(F.struct("met", "q")).alias("b")).select(F.col("b.q").alias("q"), "m")
        best = cut(best, "ngram-best")
        labels = self._link(best, None)
        other = cut(self._apart(pairs.select("q", "m").join(best, ["q", "m"], "left_anti"), labels), "ngram-other")
        labels = self._link(other, labels)
        done = cut(pairs.select(F.least("q", "m").alias("x"), F.greatest("q", "m").alias("y")).distinct(), "ngram-done")
        self._drop(best, other, pairs)
        pivots, size = None, open_.count()
        for turn in range(rounds + 1):
            named = open_.join(self._sized(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
            blocks = named.groupBy("block").agg(F.count("*").alias("rows"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
            blocks = cut(blocks.select("block", "rows", (F.col("rows") * (F.col("rows") - 1) / 2).alias("pairs")), "ngram-unsettled")
            left = blocks.agg(F.sum("pairs")).first()[0] or 0
            if not left:
                self._drop(blocks)
                break
            rest = cut(attach(named, blocks.select("block", "rows"), "block", "rows", "inner"), "ngram-rest")
            self._drop(blocks, open_)
            open_ = rest.drop("label", "rows")  # blocks that are settled stay so
            open_.terrane_path = rest.terrane_path
            if left <= max(eager * size, 100_000) or turn == rounds:
                more = self._tiles(rest)
                labels = self._link(more, labels, sure=True)
                self._drop(more)
                break
            further = self._further(rest, pivots)
            now = further.select("block", "q").distinct()
            was, pivots = pivots, cut(now if pivots is None else pivots.unionByName(now).distinct(), "ngram-pivots")
            ways = further.select("q", "m").distinct().withColumns({"x": F.least("q", "m"), "y": F.greatest("q", "m")}).join(done, ["x", "y"], "left_anti")
            more = cut(ways.groupBy("x", "y").agg(F.first("q").alias("q"), F.first("m").alias("m")).select("q", "m"), "ngram-more")
            labels = self._link(more, labels)
            old, done = done, cut(done.unionByName(more.select(F.least("q", "m").alias("x"), F.greatest("q", "m").alias("y"))).distinct(), "ngram-done")
            self._drop(further, more, old, *([was] if was is not None else []))
        self._drop(open_, done, *([pivots] if pivots is not None else []))
        return labels

    def _tiles(self, rest: DataFrame) -> DataFrame:
        """Pairs of unsettled blocks whose components differ and whose sizes, positions and sketches allow a link."""
        told = rest.join(self.nodes.select("node", "sketch"), "node")
        tiles = F.ceil(F.col("rows") / TILE_ROWS).cast("bigint")
        own = F.pmod(F.xxhash64("node"), tiles)
        dealt = told.select("block", "node", "n", "pos", "label", "sketch", own.alias("tile"), F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1)).alias("other"))
        dealt = dealt.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("other")
        return cut(dealt.groupBy("block", "low", "high").applyInArrow(tidy_group(_compare), "q bigint, m bigint").distinct(), "ngram-more")

    def _further(self, rest: DataFrame, pivots: DataFrame | None) -> DataFrame:
        """The next pivot of each component in a block against the block's other components' nodes: its least rare node."""
        free = rest if pivots is None else rest.join(pivots.select("block", F.col("q").alias("node")), ["block", "node"], "left_anti")
        best = free.groupBy("block").agg(F.min(F.struct("pos", "node", "n", "label")).alias("p"), F.count("*").alias("w"))
        best = best.select("block", "p.*").select("block", F.col("node").alias("q"), F.col("n").alias("qn"), F.col("pos").alias("qpos"), F.col("label").alias("qlabel"))
        counts = rest.groupBy("block").agg(F.count("*").alias("rows"))
        chosen = cut(best.join(counts, "block"), "ngram-chosen")
        joined = attach(rest.drop("rows"), chosen, "block", "rows", "inner")
        need = F.expr(f"ceil({PERCENT} * (n + qn) / {100 + PERCENT})")
        found = joined.filter((F.col("label") != F.col("qlabel")) & (F.least(F.col("n") - F.col("pos"), F.col("qn") - F.col("qpos")) >= need)).select("block", "q", F.col("node").alias("m"))
        found = cut(found, "ngram-further")
        self._drop(chosen)
        return found

    def rows(self) -> DataFrame:
        """(doc_id, mark, n, node, label, component_id) for every row of the documents."""
        labels = self.components()
        named = self.nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = cut(named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_nodes")), "ngram-components")
        per_node = cut(attach(named.select("node", "rows", "label"), least, "label", "n_nodes").select("node", "rows", "label", "component_id"), "ngram-result")
        self._drop(labels, least, self.nodes)
        out = attach(self.sets, per_node, "node", "rows").drop("rows")
        return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))

    def report(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) for every row."""
        return self.rows().select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def text_mark(text: Column) -> Column:
    """Tells apart the texts of rows with one id."""
    return F.xxhash64(text)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return NgramJoin(docs, id_col, text_col).report()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component, one for each; all columns kept.

    Of several such rows the one whose text has the smallest hash stays. Rows without an id or without words stay.
    """
    spark = docs.sparkSession
    found = cut(NgramJoin(docs, id_col, text_col).rows().filter("node IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "mark", "label", "component_id"), "near-groups")
    first = found.filter("component_id = doc_id").groupBy("label").agg(F.min("mark").alias("mark"), F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    first = cut(first, "near-first")
    dropped = cut(found.select("doc_id", "mark").distinct().join(first.select("doc_id", "mark"), ["doc_id", "mark"], "left_anti"), "near-dropped")
    keys = {"doc_id": F.col(f"`{id_col}`").cast("bigint"), "mark": text_mark(F.col(f"`{text_col}`").cast("string"))}
    stay = keep_without(docs, dropped, keys, dropped.count(), 24)
    twice = first.filter("n > 1").select("doc_id", "mark").join(found, ["doc_id", "mark"]).groupBy("doc_id", "mark").count().filter("count > 1").select("doc_id", "mark")
    twice = cut(twice, "near-twice")
    drop_path(spark, found)
    drop_path(spark, first)
    if n := twice.count():  # repeated rows: one of each set
        once = keep_without(stay, twice, keys, n, 24)
        names = free_names(docs.columns, *(f"key_{k}" for k in keys))
        others = free_names([*docs.columns, *names], *(f"other_{k}" for k in keys))
        right = few(twice.select(*[F.col(k).alias(o) for k, o in zip(keys, others, strict=True)]), n, 24)
        again = stay.withColumns(dict(zip(names, keys.values(), strict=True))).join(right, [F.col(a) == F.col(o) for a, o in zip(names, others, strict=True)], "left_semi")
        stay = once.unionByName(again.dropDuplicates(names).select(*[F.col(f"`{c}`") for c in docs.columns]))
    return stay


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
