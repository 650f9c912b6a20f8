"""Hierarchical Pitman-Yor language model of words, the word before them and their spelling, and text scores.

Every word is a restaurant that serves the words after it; the end token's serves the first words. Each table there
orders a word from the word restaurant that all contexts share as their parent; each of its tables orders a word from
the kitchen that spells words byte by byte. There, contexts of up to three bytes are restaurants whose parent lacks
the oldest byte, down to a uniform choice. Seating is sampled by Gibbs sweeps: a sweep draws each dish's number of
tables from its conditional given all other tables, with the sizes of the tables summed out (generalised Stirling
numbers: from their table up to LADDER customers of one dish, by a saddle point beyond). Chance comes from hashes of the words, so results do not depend on the partitioning. Probabilities of
words and the tables of pairs are averaged over samples after burn-in.

All counts stay distributed, as packed arrays: pairs in buckets by their first word (frequent first words by the pair),
words in buckets by their hash. In a sweep, buckets of pairs send words their tables and receive probabilities. To
score, texts are hashed in chunks; a chunk asks each bucket for its distinct pairs and sums the answers by text, so
nothing that is sent grows with repetition, and no key gathers more than one request of each chunk. Pairs that no
training text has back off to the word without its context. Documents are scored in ROUNDS parts to bound the disk.

Bounds. The driver and each worker hold the kitchen (at most 32 * 32 * 32 * 256 cells, as bytes of context count by class) and words with
more than 1/HOT_SHARE of all tokens (at most HOT_SHARE of them). Words and pairs are told apart by 64-bit hashes:
among n distinct ones about n^2 / 2^65 are confused.

Cases. A null text counts as empty: it has the end token only. A null id counts as an empty text for the split. Rows
with repeated ids, or equal texts, are scored one by one and equal texts alike. A word that was never seen gets the
back-off weights times the probability of its spelling, while the base score has one class for all of them; so the
scores of known words are also given by themselves. Long texts are read whole; a chunk holds at least one text. Empty
tables give empty results. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import LOWER, mix, small_batches, word_hashes
from terrane.session import cut, drop_path, files_for, new_path, shuffles_removed

#: Every seventh hash class is held out.
FOLDS, HELD = 7, 2
#: Text bytes of a bucket of pairs, tokens after which counts are sent on, tokens of a chunk, and bytes that are hashed at a time.
BUCKET_BYTES, TASK_TOKENS, CHUNK_TOKENS, GROUP_BYTES = 8 << 20, 1 << 19, 1 << 18, 1 << 19
#: Words that hold more than 1/HOT_SHARE of all tokens may be dealt out by pair.
HOT_SHARE = 100_000
#: Sweeps before the first sample, samples, strength, customers of one dish for which there are tabled weights.
BURN, SAMPLES, STRENGTH, LADDER = 1, 3, 1.0, 1024
#: Parts in which texts are scored.
ROUNDS = 4
#: The end token's hash, and the byte that ends a word and stands before it; no word has either.
END_ID, END = np.uint64(0), 0x20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = LOWER.tobytes()
#: Bytes of context in the kitchen. Their classes, which are letters, the end, digits, other ASCII, and parts of UTF-8.
CONTEXT = 3
CLASS = np.array([b - 0x61 if 0x61 <= b <= 0x7A else 26 if b == END else 27 if 0x30 <= b <= 0x39 else 28 if b < 0x80 else 29 if b < 0xC0 else 30 if b < 0xE0 else 31 for b in range(256)], np.int32)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


# Packed arrays.


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one dimension as bytes."""
    heads = [struct.pack("<2sq", a.dtype.str[1:].encode(), a.nbytes) for a in arrays]
    return b"".join([struct.pack("<B", len(arrays)), *heads, *(a.tobytes() for a in arrays)])


def unpack(blob: bytes) -> list[np.ndarray]:
    count, out = blob[0], []
    at = 1 + 10 * count
    for i in range(count):
        kind, size = struct.unpack_from("<2sq", blob, 1 + 10 * i)
        kind = np.dtype(kind.decode())
        out.append(np.frombuffer(blob, kind, size // kind.itemsize, at))
        at += size
    return out


def slim(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of data[start : start + size], one after another."""
    size = size.astype(np.int64)
    before = np.cumsum(size) - size
    return data[np.arange(int(size.sum())) + np.repeat(start - before, size)]


def starts_of(sizes: np.ndarray) -> np.ndarray:
    sizes = sizes.astype(np.int64)
    return np.cumsum(sizes) - sizes


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal numbers starts, and how long it is."""
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def found_in(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in sorted ``keys``, and whether they hit."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def order_of(keys: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers of 64 bits that are small or spread, as hashes are, by sorting numbers that end in their places."""
    n = len(keys)
    bits, top = np.uint64(max(n - 1, 0).bit_length()), int(keys.max(initial=0))
    place, keys = np.arange(n, dtype=np.uint64), keys.astype(np.uint64, copy=False)
    exact = top.bit_length() + int(bits) <= 64
    order = np.sort((keys << bits if exact else keys >> bits << bits) | place) & ((np.uint64(1) << bits) - np.uint64(1))
    order = order.astype(np.int64)
    if not exact:  # different keys may agree in the bits that are left
        found = keys[order]
        if (found[1:] < found[:-1]).any():
            return np.argsort(keys, kind="stable")
    return order


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where the first of each is, and each key's place among them."""
    order = order_of(keys)
    keys = keys[order]
    first, size = runs_of(keys)
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(first)), size)
    return keys[first], order[first], place


def by_bucket(bucket: np.ndarray) -> np.ndarray:
    """Order by bucket that leaves equals as they are."""
    return np.argsort(slim(bucket), kind="stable")


ROW_DDL = "kind string, bucket bigint, src bigint, blob binary, n double"
_ROW = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("src", pa.int64()), ("blob", pa.binary()), ("n", pa.float64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _parts(table: pa.Table) -> dict[str, list[tuple[int, list[np.ndarray]]]]:
    """kind -> [(src, arrays)], by src."""
    out: dict[str, list] = {}
    blobs = [v.as_buffer() for v in table.column("blob")]  # not copied
    for kind, src, blob in zip(table.column("kind").to_pylist(), table.column("src").to_pylist(), blobs, strict=True):
        out.setdefault(kind, []).append((src or 0, unpack(blob)))
    for v in out.values():
        v.sort(key=lambda r: r[0])
    return out


def _joined(parts: list, i: int, kind=None) -> np.ndarray:
    """The i-th arrays of all parts, one after another."""
    found = [p[1][i] for p in parts]
    out = np.concatenate(found) if found else np.zeros(0, kind or np.float64)
    return out.astype(kind) if kind else out


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of a sorted bucket column."""
    first, size = runs_of(bucket)
    for b, a, n in zip(bucket[first].tolist(), first.tolist(), size.tolist(), strict=True):
        yield b, slice(a, a + n)


# Words and pairs of texts.


@dataclass
class Group:
    """Some texts: hash of each word, with the end token after each text; where words lie in data; tokens per text."""

    w: np.ndarray
    start: np.ndarray
    size: np.ndarray
    data: np.ndarray
    tokens: np.ndarray

    @property
    def x(self) -> np.ndarray:
        """The token before each."""
        return np.concatenate(([END_ID], self.w[:-1]))


def groups(texts: list[str | None]) -> Iterator[Group]:
    """The lower-cased words of whole texts, about GROUP_BYTES at a time."""
    held: list[bytes] = []
    total = 0
    for i, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass"))
        total += len(held[-1])
        if total >= GROUP_BYTES or i + 1 == len(texts):
            data = np.frombuffer((b"\n".join(held) + b"\n").translate(_LOWER), np.uint8)
            start, end, h = word_hashes(data)
            bound = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in held)]))
            last = bound[1:]
            yield Group(np.insert(h, last, END_ID), np.insert(start, last, 0), np.insert(end - start, last, 0), data, np.diff(bound) + 1)
            held, total = [], 0


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of the whole text; the empty word is the end token."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def word_id(word: bytes) -> np.uint64:
    return word_hashes(np.frombuffer(word.lower() + b"\n", np.uint8))[2][0] if word else END_ID


def pair_key(x: np.ndarray, w: np.ndarray, size: np.ndarray | int = 1) -> np.ndarray:
    """Of pairs of words, or of contexts with the words after each, so many of them."""
    return mix(np.repeat(mix(x) * _ODD, size) + w if np.ndim(size) else mix(x) * _ODD + w)


@dataclass
class Deal:
    """Which bucket holds what: pairs in 0 .. pairs - 1, words in pairs .. pairs + words - 1. hot: sorted hashes."""

    pairs: int
    words: int
    hot: np.ndarray

    def of_pairs(self, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        h = mix(x + _ODD)
        if len(self.hot):
            h = np.where(found_in(self.hot, x)[1], mix(k + _ODD), h)
        return (h % np.uint64(self.pairs)).astype(np.int64)

    def of_words(self, w: np.ndarray) -> np.ndarray:
        return (mix(w + _ODD) % np.uint64(self.words)).astype(np.int64) + self.pairs

    def word_order(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words by bucket and hash, their buckets, and each word's place among them."""
        u, _, rank = distinct(w)
        bucket = self.of_words(u)
        order = by_bucket(bucket)
        place = np.empty(len(u), np.int64)
        place[order] = np.arange(len(u))
        return u[order], bucket[order], place[rank]


# Tables of a dish.


@functools.lru_cache(maxsize=8)
def stirling(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers: weight of all ways to seat c customers at t tables of one dish."""
    out = np.full((LADDER + 1, LADDER + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(LADDER + 1)
    with np.errstate(divide="ignore"):
        for c in range(LADDER):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0.0))
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def chance(keys: np.ndarray, turn: int) -> np.ndarray:
    """A number in (0, 1) for each key and turn."""
    salt = mix(np.array([turn + 1], np.uint64))[0]
    return ((mix(keys.astype(np.uint64) ^ salt) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def draw_tables(c: np.ndarray, parent: np.ndarray, others: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """Number of tables of dishes with c customers, given their parent's probability and the restaurant's other tables."""
    c = c.astype(np.int64)
    out = np.minimum(c, 1)
    first = np.minimum(c, LADDER)
    ladder = stirling(discount)
    width = 2
    while width // 2 < LADDER:
        rows = np.flatnonzero((first > width // 2) & (first <= width))
        t = np.arange(1, width + 1)
        for at in range(0, len(rows), max(1, 1_000_000 // width)):
            r = rows[at : at + max(1, 1_000_000 // width)]
            if width <= 16:  # a vector for each number of tables
                out[r] = _draw_few(first[r], ladder[:, : width + 1], parent[r], others[r], discount, u[r])
                continue
            weight = ladder[first[r], 1 : width + 1] + t * np.log(parent[r])[:, None] + np.cumsum(np.log(STRENGTH + discount * (others[r][:, None] + t - 1)), axis=1)
            p = np.cumsum(np.exp(weight - weight.max(axis=1)[:, None]), axis=1)
            out[r] = np.minimum((p < (u[r] * p[:, -1])[:, None]).sum(axis=1) + 1, first[r])
        width *= 2
    large = np.flatnonzero(c > LADDER)
    if len(large):
        out[large] = _draw_many(c[large].astype(np.float64), parent[large], others[large], discount, u[large])
    return out


def _draw_few(c: np.ndarray, ladder: np.ndarray, parent: np.ndarray, others: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    back, ways, weight = np.log(parent), 0.0, []
    for t in range(1, ladder.shape[1]):
        ways = ways + np.log(STRENGTH + d * (others + (t - 1)))
        weight.append(ladder[:, t][c] + t * back + ways)
    top, total, p = functools.reduce(np.maximum, weight), 0.0, []
    for w in weight:
        total = total + np.exp(w - top)
        p.append(total)
    out, limit = np.ones(len(c), np.int64), u * total
    for x in p:
        out += x < limit
    return np.minimum(out, c)


def _share(t: np.ndarray, c: np.ndarray, d: float) -> np.ndarray:
    """1 - s^d at the saddle point s of the numbers' generating function, by halving log s."""
    ratio = np.log(t * d / c)
    low = np.minimum(ratio, 0.0) / (1 - d) - 1
    high = np.zeros(np.broadcast(t, c).shape)
    low = low + high
    for _ in range(40):
        y = (low + high) / 2
        up = ratio + np.log(-np.expm1(y)) + (d - 1) * y - np.log(-np.expm1(d * y)) > 0
        low, high = np.where(up, y, low), np.where(up, high, y)
    return -np.expm1(d * (low + high) / 2)


def _draw_many(c: np.ndarray, parent: np.ndarray, others: np.ndarray, d: float, u: np.ndarray, grid: int = 64) -> np.ndarray:
    """The same draw for dishes with many customers, from the slope of the log weight by a saddle point, on a grid around its top."""
    c, parent, others, u = c[:, None], np.minimum(parent, 1 - 1e-9)[:, None], others[:, None] + STRENGTH / d, u[:, None]
    slope = lambda t: np.log((others + t - 0.5) * parent * _share(t, c, d) / (t - 0.5))
    low, high = np.ones_like(c), c - 1
    for _ in range(40):
        t = np.sqrt(low * high)
        up = slope(t) > 0
        low, high = np.where(up, t, low), np.where(up, high, t)
    top = np.sqrt(low * high)
    width = 1 / np.sqrt(np.maximum((slope(top) - slope(top * 1.01)) / (0.01 * top), 1e-300))
    width = np.minimum(width, 4 * top + 10)
    first = np.maximum(1.0, np.floor(top - 6 * width))
    step = np.maximum(1.0, np.ceil((top + 8 * width - first) / grid))
    t = np.minimum(first + step * np.arange(grid), c - 1)
    log = np.cumsum(np.concatenate([np.zeros_like(c), step * slope((t[:, :-1] + t[:, 1:]) / 2)], axis=1), axis=1)
    p = np.cumsum(np.exp(log - log.max(axis=1)[:, None]), axis=1)
    cell = np.minimum((p < u * p[:, -1:]).sum(axis=1), grid - 1)
    at = np.arange(len(c))
    within = (u[:, 0] * p[:, -1] - np.where(cell > 0, p[at, np.maximum(cell, 1) - 1], 0)) / np.maximum(np.diff(p, axis=1, prepend=0)[at, cell], 1e-300)
    return np.clip(np.round(t[at, cell] + (within - 0.5) * (step[:, 0] - 1)), 1, c[:, 0]).astype(np.int64)


def discount_from(one: float, two: float) -> float:
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


# Spelling.


def spelling(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word and its end: the classes of the bytes before and the byte as one number; and where words start."""
    size = size.astype(np.int64)
    start, letter = starts_of(size + 1), np.ones(len(data) + len(size), bool)
    letter[start + size] = False
    flat = np.full(CONTEXT + len(letter), END, np.uint8)
    flat[CONTEXT:][letter] = data
    key, kind = flat[CONTEXT:].astype(np.int32), CLASS[flat]
    for back in range(1, CONTEXT + 1):
        before = kind[CONTEXT - back : len(kind) - back] << (3 + 5 * back)
        for near in range(back - 1):  # bytes of the word before do not count
            before[start[size >= near] + near] = CLASS[END] << (3 + 5 * back)
        key |= before
    return key, start


def _lower(keys: np.ndarray, level: int) -> np.ndarray:
    """The same bytes after contexts without their oldest byte."""
    return keys & (1 << 3 + 5 * level) - 1


class Speller:
    """Probability of each byte after contexts of 0 .. CONTEXT bytes by class; levels: sorted keys, probabilities, and per context the share of its parent."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.seats: list[tuple[np.ndarray, np.ndarray]] = []

    @classmethod
    def sample(cls, keys: np.ndarray, customers: np.ndarray, before: Speller | None, turn: int) -> Speller:
        """Seat the customers of the longest contexts, then their tables' orders in the parents, and so on down. keys: sorted."""
        seated = []
        for level in range(CONTEXT, -1, -1):
            discount = discount_from(float((customers == 1).sum()), float((customers == 2).sum()))
            parent = before.probability(_lower(keys, level), level - 1) if before else np.full(len(keys), 1 / 64)
            if before is None:
                tables = np.minimum(customers, np.maximum(1, np.floor(customers**discount)))
            else:
                at, hit = found_in(before.seats[level][0], keys)
                tables = np.where(hit, np.clip(before.seats[level][1][at], 1, customers), 1)
            total = np.bincount(keys >> 8, tables, 1 << 5 * level)
            tables = draw_tables(customers, parent, total[keys >> 8] - tables, discount, chance(keys.astype(np.uint64) + np.uint64(level << 40), turn))
            seated.append((keys, customers, tables, discount))
            if level:
                keys, at = np.unique(_lower(keys, level), return_inverse=True)
                customers = np.bincount(at, tables, len(keys)).astype(np.int64)
        model = cls()
        for level, (keys, customers, tables, discount) in enumerate(reversed(seated)):
            context = keys >> 8
            everyone, total = np.bincount(context, customers, 1 << 5 * level), np.bincount(context, tables, 1 << 5 * level)
            back = (STRENGTH + discount * total) / (STRENGTH + everyone)
            p = (customers - discount * tables) / (STRENGTH + everyone[context]) + back[context] * model.probability(_lower(keys, level), level - 1)
            model.levels.append((keys, p, back))
            model.seats.append((keys, tables))
        return model

    def probability(self, keys: np.ndarray, level: int = -2) -> np.ndarray:
        """Of each byte in its context; unseen ones from shorter contexts."""
        level = CONTEXT if level == -2 else level
        if level < 0:
            return np.full(len(keys), 1 / 256)
        known, p, back = self.levels[level]
        at, hit = found_in(known, keys)
        out = p[at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            out[miss] = back[keys[miss] >> 8] * self.probability(_lower(keys[miss], level), level - 1)
        return out


@dataclass
class Spelled:
    """Words as cells of the kitchen: the sorted cells that they meet, each byte's place among them, where words start and end."""

    cells: np.ndarray
    place: np.ndarray
    bound: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, size: np.ndarray) -> Spelled:
        bound = np.concatenate(([0], np.cumsum(size.astype(np.int64) + 1)))
        place, at = np.empty(int(bound[-1]), np.int32), 0
        met, rank = np.zeros(1 << 8 + 5 * CONTEXT, bool), np.empty(1 << 8 + 5 * CONTEXT, np.int32)
        for some, letters in _portions(data, size):
            keys = spelling(letters, some)[0]
            met[keys] = True
            place[at : at + len(keys)] = keys
            at += len(keys)
        cells = np.flatnonzero(met)
        rank[cells] = np.arange(len(cells))
        return cls(cells, np.take(rank, place, out=place, mode="clip"), bound)

    def portions(self, words: int = 1 << 15) -> Iterator[tuple[int, int]]:
        """Some words at a time."""
        for a in range(0, len(self.bound) - 1, words):
            yield a, min(len(self.bound) - 1, a + words)

    def log(self, speller: Speller) -> np.ndarray:
        """log10 probability of spelling each word."""
        p, out = np.log10(speller.probability(self.cells)), [np.zeros(0)]
        for a, b in self.portions():
            first = self.bound[a]
            out.append(np.add.reduceat(p[self.place[first : self.bound[b]]], self.bound[a:b] - first))
        return np.concatenate(out)

    def grams(self, t: np.ndarray) -> list[tuple]:
        """How often each byte follows its context in t orders of each word."""
        total = np.zeros(len(self.cells))
        for a, b in self.portions():
            total += np.bincount(self.place[self.bound[a] : self.bound[b]], np.repeat(t[a:b], np.diff(self.bound[a : b + 1])), len(total))
        return [("g", i, None, None, n) for i, n in zip(self.cells.tolist(), total.tolist(), strict=True)]


def log_words(speller: Speller, data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """log10 probability of spelling each word."""
    return Spelled.of(data, size).log(speller)


def _portions(data: np.ndarray, size: np.ndarray, words: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sizes and bytes of some words at a time."""
    ends = np.concatenate(([0], np.cumsum(size.astype(np.int64))))
    for a in range(0, len(size), words):
        b = min(len(size), a + words)
        yield size[a:b], data[ends[a] : ends[b]]


# Counting.


def _trained(batch: pa.RecordBatch) -> list[str | None]:
    return [t for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not held_out(d)]


def _merged_words(w, c, size, data) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    u, first, at = distinct(w)
    return u, np.bincount(at, c, len(u)).astype(np.int64), size[first], spans(data, starts_of(size)[first], size[first])


def _count_words(deal: Deal):
    def flush(parts: list) -> pa.RecordBatch:
        w, c, size, data = _merged_words(*(np.concatenate([p[i] for p in parts]) for i in range(4)))
        bucket = deal.of_words(w)
        order = by_bucket(bucket)
        start, w, c, size, rows = starts_of(size)[order], w[order], c[order], size[order], []
        for b, s in _slices(bucket[order]):
            rows.append(("v", b, None, pack(w[s], slim(c[s]), slim(size[s]), spans(data, start[s], size[s])), None))
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for g in groups(_trained(batch)):
                order = order_of(g.w)
                first, c = runs_of(g.w[order])
                first = order[first]
                parts.append((g.w[first], c, g.size[first], spans(g.data, g.start[first], g.size[first])))
                held += len(c)
                if held > TASK_TOKENS:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _merge_words(key: tuple, table: pa.Table) -> pa.Table:
    parts = _parts(table)["v"]
    w, c, size, data = _merged_words(*(_joined(parts, i, np.uint8 if i == 3 else np.int64 if i else np.uint64) for i in range(4)))
    return _table([("v", key[0].as_py(), None, pack(w, slim(c), slim(size), data), None), ("tokens", None, None, None, float(c.sum())), ("distinct", None, None, None, float(len(w)))])


def _hot_words(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob in batch.column("blob").to_pylist():
                w, c, *_ = unpack(blob)
                at = np.flatnonzero(c >= limit)
                rows += [("hot", i, None, None, float(n)) for i, n in zip(w[at].view(np.int64).tolist(), c[at].tolist(), strict=True)]
            yield _batch(rows)

    return run


def _csr(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, size = runs_of(x)
    return x[first], slim(size)


def _count_pairs(deal: Deal):
    def flush(parts: list) -> pa.RecordBatch:
        k, x, w = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = order_of(k)
        first, c = runs_of(k[order])
        order = order[first]
        k, x, w = k[order], x[order], w[order]
        order = order_of(x)
        bucket = deal.of_pairs(x, k)[order]
        again = by_bucket(bucket)
        bucket, order = bucket[again], order[again]
        x, w, c = x[order], w[order], c[order]
        return _batch([("p", b, None, pack(*_csr(x[s]), w[s], slim(c[s])), None) for b, s in _slices(bucket)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for g in groups(_trained(batch)):
                x = g.x
                parts.append((pair_key(x, g.w), x, g.w))
                held += len(x)
                if held > TASK_TOKENS:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _merge_pairs(deal: Deal):
    """The bucket's pairs by context (b); those that were seen more than once with one table each (m); what it tells words (k, e).

    A pair names its word by place among the bucket's words, which are ordered by bucket and hash.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        me, parts = key[0].as_py(), _parts(table)["p"]
        xs, _, rank = distinct(_joined(parts, 0, np.uint64))
        uw, bucket, place = deal.word_order(_joined(parts, 2, np.uint64))
        # A pair as one number: its context's rank, then its word's place.
        pair, _, at = distinct(np.repeat(rank, _joined(parts, 1, np.int64)) * len(uw) + place)
        c = np.bincount(at, _joined(parts, 3, np.int64), len(pair)).astype(np.int64)
        xi, place = np.divmod(pair, len(uw))
        x = xs[xi]
        rows = [("b", me, None, pack(*_csr(x), (place & 0xFFFF).astype(np.uint16), slim(place >> 16), slim(c)), None)]
        rows += [("one", None, None, None, float((c == 1).sum())), ("two", None, None, None, float((c == 2).sum()))]
        kinds = np.bincount(place, minlength=len(uw))
        rows += [("k", b, me, pack(uw[s], slim(kinds[s])), None) for b, s in _slices(bucket)]
        many = c > 1
        kept = found_in(deal.hot, xs)[1]  # frequent contexts in any case
        kept[xi[many]] = True
        mx, to = xs[kept], np.cumsum(kept) - 1
        ones = np.bincount(to[xi[~many & kept[xi]]], minlength=len(mx))
        xi, place, n = to[xi[many]], place[many], int(many.sum())
        kept = np.zeros(len(uw), bool)
        kept[place] = True
        mw, bucket, wi = uw[kept], bucket[kept], (np.cumsum(kept) - 1)[place]
        rows.append(("m", me, None, pack(mx, slim(ones), mw, slim(xi), slim(wi), slim(c[many]), np.ones(n, np.uint8), np.zeros(n, np.uint8)), None))
        rows += [("e", b, me, pack(mw[s], np.zeros(s.stop - s.start, np.uint8)), None) for b, s in _slices(bucket)]
        return _table(rows + _hot_tables(deal, x, np.ones(len(x), np.int64)))

    return run


def _hot_tables(deal: Deal, x: np.ndarray, t: np.ndarray) -> list[tuple]:
    """Tables that frequent contexts have in this bucket."""
    at, hit = found_in(deal.hot, x)
    total = np.bincount(at[hit], t[hit], len(deal.hot)) if len(deal.hot) else np.zeros(0)
    return [("hx", i, None, None, float(total[i])) for i in np.flatnonzero(total).tolist()]


def _open_words(key: tuple, table: pa.Table) -> pa.Table:
    """Words with the number of their contexts, one table each."""
    parts = _parts(table)
    _, (w, c, size, data) = parts["v"][0]
    at, _ = found_in(w, _joined(parts.get("k", []), 0, np.uint64))
    kinds = np.bincount(at, _joined(parts.get("k", []), 1, np.int64), len(w)).astype(np.int64)
    rows = [("v", key[0].as_py(), None, pack(w, c, size, data, slim(kinds)), None), ("s", key[0].as_py(), None, pack(np.ones(len(w), np.uint8)), None)]
    rows += [("one", None, None, None, float((kinds == 1).sum())), ("two", None, None, None, float((kinds == 2).sum()))]
    return _table(rows + Spelled.of(data, size).grams(np.ones(len(w))))


# Gibbs sweeps.


def _seat_words(turn: int, told, tables: float, discount: float, keep: bool):
    """The word restaurant: customers are the tables of all contexts. Answers each bucket's words in its order."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        me, parts = key[0].as_py(), _parts(table)
        _, (w, _, size, data, kinds) = parts["v"][0]
        was, *kept = parts["s"][0][1]
        k = kinds.astype(np.int64)
        places = {src: found_in(w, asked)[0] for src, (asked, _) in parts.get("e", [])}
        for src, (_, extra) in parts.get("e", []):
            np.add.at(k, places[src], extra.astype(np.int64))
        spelled = Spelled.of(data, size)
        h = 10 ** spelled.log(told.value)
        t = draw_tables(k, np.maximum(h, 1e-300), tables - was, discount, chance(w, 2 * turn))
        own = k - discount * t
        rows = [("r", src, me, pack(own[at], h[at]), None) for src, at in places.items()]
        rows.append(("s", me, None, pack(slim(t), *kept, *([own, h] if keep else [])), None))
        rows += [("tables", None, None, None, float(t.sum())), ("customers", None, None, None, float(k.sum()))]
        return _table(rows + spelled.grams(t))

    return run


def _seat_pairs(turn: int, deal: Deal, hot_tables: np.ndarray, tables: float, customers: float, of_word: float, of_pair: float, keep: bool, last: bool):
    """The context restaurants of a bucket, given the words' probabilities. The last turn leaves sums of tables only (t)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        me, parts = key[0].as_py(), _parts(table)
        if "m" not in parts:
            return _table([])
        mx, ones, mw, xi, wi, c, t, total = parts["m"][0][1]
        xi, wi, ones, t = xi.astype(np.int64), wi.astype(np.int64), ones.astype(np.int64), t.astype(np.int64)
        own, h = _joined(parts.get("r", []), 0), _joined(parts.get("r", []), 1)
        p = (own + (STRENGTH + of_word * tables) * h) / (STRENGTH + customers)
        here = ones + np.bincount(xi, t, len(mx))
        at, hit = found_in(deal.hot, mx)
        if len(deal.hot):
            here = np.where(hit, hot_tables[at], here)
        keys = pair_key(mx[xi], mw[wi])
        now = draw_tables(c, p[wi], here[xi] - t, of_pair, chance(keys, 2 * turn + 1))
        total = total.astype(np.int64) + (now if keep else 0)
        rows = _hot_tables(deal, mx, np.bincount(xi, now, len(mx)) + ones)
        if last:
            return _table([*rows, ("t", me, None, pack(slim(total)), None)])
        extra = np.bincount(wi, now - 1, len(mw)).astype(np.int64)
        rows += [("e", b, me, pack(mw[s], slim(extra[s])), None) for b, s in _slices(deal.of_words(mw))]
        return _table([*rows, ("m", me, None, pack(mx, slim(ones), mw, slim(xi), slim(wi), c, slim(now), slim(total)), None)])

    return run


@dataclass
class WordModel:
    """The averaged restaurants, in tables of packed buckets, and what all workers are told.

    pairs: kinds b (pairs), t (tables of those seen more than once), a (the bucket's words with their probability and count);
    words: kind f (words with their count and probability); spelled: kind v (words with their spelling). samples: (tables, customers) of the word restaurant.
    """

    deal: Deal
    pairs: list[DataFrame]
    words: DataFrame
    spelled: DataFrame
    tokens: int
    distinct: int
    of_pair: float
    of_word: float
    samples: list[tuple[float, float]]
    spellers: list[Speller]
    hot_counts: np.ndarray
    hot_tables: np.ndarray

    def known_words(self) -> DataFrame:
        """(word, w, c, logp): log10 of each word's averaged probability without context."""
        return _union([self.words, self.spelled]).groupBy("bucket").applyInArrow(_show_words, "word binary, w bigint, c bigint, logp double")

    def known_pairs(self) -> DataFrame:
        """(x, w, logp) of each pair, and for each context a row without w: the log10 share that it passes on to its parent."""
        return _union(self.pairs).groupBy("bucket").applyInArrow(_show_pairs(self._rule()), "x bigint, w bigint, logp double")

    def _rule(self) -> Rule:
        return Rule(self.deal, self.of_pair, self.of_word, self.samples, self.hot_counts, self.hot_tables)


@dataclass
class Rule:
    """How probabilities follow from seats."""

    deal: Deal
    of_pair: float
    of_word: float
    samples: list[tuple[float, float]]
    hot_counts: np.ndarray
    hot_tables: np.ndarray

    def word_chances(self, kept: list[np.ndarray]) -> np.ndarray:
        p = [(own + (STRENGTH + self.of_word * t) * h) / (STRENGTH + k) for own, h, (t, k) in zip(kept[::2], kept[1::2], self.samples, strict=True)]
        return sum(p) / len(p)

    def bucket(self, parts: dict) -> tuple:
        """Contexts, how many pairs each has, and the log10 share that goes to its parent; w, log10 probability and count of w of each pair."""
        if "b" not in parts:
            none = np.zeros(0)
            return none.astype(np.uint64), none.astype(np.int64), none, none.astype(np.uint64), none, none.astype(np.uint8)
        xs, size, low, high, c = parts["b"][0][1]
        size, place, c = size.astype(np.int64), low.astype(np.int64) | high.astype(np.int64) << 16, c.astype(np.int64)
        t = np.ones(len(c))
        if "t" in parts:
            t[c > 1] = parts["t"][0][1][0].astype(np.float64) / len(self.samples)
        first = starts_of(size)
        customers, tables = (np.add.reduceat(v, first) for v in (c.astype(np.float64), t))
        if len(self.deal.hot):
            at, hit = found_in(self.deal.hot, xs)
            customers, tables = np.where(hit, self.hot_counts[at], customers), np.where(hit, self.hot_tables[at], tables)
        back = (STRENGTH + self.of_pair * tables) / (STRENGTH + customers)
        words, p1, counts = (_joined(parts["a"], i, kind) for i, kind in enumerate((np.uint64, np.float64, None)))
        p = (c - self.of_pair * t) / np.repeat(STRENGTH + customers, size) + np.repeat(back, size) * p1[place]
        return xs, size, np.log10(back), words[place], np.log10(p), counts[place]


def _answer_words(rule: Rule):
    """Probability and count of the words (f), and of each pair bucket's words (a)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        me, parts = key[0].as_py(), _parts(table)
        w, c = parts["v"][0][1][:2]
        p = rule.word_chances(parts["s"][0][1][1:]).astype(np.float32)
        out = [("f", me, None, pack(w, c, p), None)]
        for src, (asked, _) in parts.get("k", []):
            at, _ = found_in(w, asked)
            out.append(("a", src, me, pack(asked, p[at], c[at]), None))
        return _table(out)

    return run


def _show_words(key: tuple, table: pa.Table) -> pa.Table:
    parts = _parts(table)
    (w, c, p), (_, _, size, data, _) = parts["f"][0][1], parts["v"][0][1]
    words = [data[a : a + n].tobytes() for a, n in zip(starts_of(size).tolist(), size.tolist(), strict=True)]
    return pa.table({"word": pa.array(words, pa.binary()), "w": w.view(np.int64), "c": c.astype(np.int64), "logp": np.log10(p.astype(np.float64))})


def _show_pairs(rule: Rule):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        xs, size, back, w, logp, _ = rule.bucket(_parts(table))
        return pa.table({"x": np.concatenate([np.repeat(xs, size), xs]).view(np.int64), "w": pa.array([*w.view(np.int64).tolist(), *[None] * len(xs)], pa.int64()), "logp": np.concatenate([logp, back])})

    return run


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionAll, tables)


def _grouped(tables: list[DataFrame], run) -> DataFrame:
    return _union([t.select("kind", "bucket", "src", "blob", "n") for t in tables]).groupBy("bucket").applyInArrow(run, ROW_DDL)


def _kind(table: DataFrame, *kinds: str) -> DataFrame:
    return table.filter(F.col("kind").isin(*kinds))


def _cut(df: DataFrame, name: str) -> DataFrame:
    """Written by kind, so that each kind can be read and deleted by itself."""
    path = new_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        # A dictionary would hash every blob, and none repeats.
        df.coalesce(files_for(df)).write.partitionBy("kind").option("compression", "zstd").option("parquet.enable.dictionary#blob", "false").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.terrane_path = path
    return back


def _forget(table: DataFrame, *kinds: str) -> None:
    for kind in kinds:
        drop_path(table.sparkSession, f"{table.terrane_path}/kind={kind}")


def _numbers(table: DataFrame, *kinds: str) -> list[float]:
    got = {r.kind: r.n for r in _kind(table, *kinds).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    return [got.get(k) or 0.0 for k in kinds]


def _cells(table: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of cells and their sums, sorted."""
    got = _kind(table, kind).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(got["bucket"].to_numpy())
    return got["bucket"].to_numpy()[order], got["n"].to_numpy()[order].astype(np.int64)


def _hot_sums(table: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    if size:
        at, n = _cells(table, "hx")
        out[at] = n
    return out


def fit(docs: DataFrame, burn: int | None = None, samples: int | None = None) -> WordModel | None:
    """The model of all training texts; docs has id and text. None if there are no training texts."""
    spark = docs.sparkSession
    small_batches(spark)
    burn, samples = BURN if burn is None else burn, samples or SAMPLES
    size = docs.agg(F.sum(F.octet_length(docs.columns[1]))).first()[0] or 0
    least = max(1, spark.sparkContext.defaultParallelism)
    deal = Deal(max(least, size // BUCKET_BYTES), max(least // 2, size // (3 * BUCKET_BYTES), 1), np.zeros(0, np.uint64))
    counted = _cut(_grouped([docs.mapInArrow(_count_words(deal), ROW_DDL)], _merge_words), "words")
    tokens, distinct = map(int, _numbers(counted, "tokens", "distinct"))
    if not distinct:
        return None
    limit = max(tokens // HOT_SHARE + 1, BUCKET_BYTES // 64)
    hot = sorted((r.bucket % (1 << 64), r.n) for r in _kind(counted, "v").mapInArrow(_hot_words(limit), ROW_DDL).collect())
    deal.hot, hot_counts = np.array([h for h, _ in hot], np.uint64), np.array([n for _, n in hot])
    shops = _cut(_grouped([docs.mapInArrow(_count_pairs(deal), ROW_DDL)], _merge_pairs(deal)), "pairs")
    opened = _cut(_grouped([_kind(counted, "v"), _kind(shops, "k")], _open_words), "words")
    of_pair, of_word = discount_from(*_numbers(shops, "one", "two")), discount_from(*_numbers(opened, "one", "two"))
    words, state, seats = _kind(opened, "v"), opened, shops
    drop_path(spark, counted)
    spellers, kept, tables = [], [], float(distinct)
    hot_tables, mean_hot, speller = _hot_sums(shops, len(hot)), np.zeros(len(hot)), None
    for turn in range(burn + samples):
        keep = turn >= burn
        speller = Speller.sample(*_cells(state, "g"), speller, turn)
        told = spark.sparkContext.broadcast(speller)
        served = _cut(_grouped([words, _kind(state, "s"), _kind(seats, "e")], _seat_words(turn, told, tables, of_word, keep)), "served")
        _forget(state, "s", "g")
        _forget(seats, "e")
        tables, customers = _numbers(served, "tables", "customers")
        seat = _seat_pairs(turn, deal, hot_tables, tables, customers, of_word, of_pair, keep, turn == burn + samples - 1)
        moved = _cut(_grouped([_kind(seats, "m"), _kind(served, "r")], seat), "seated")
        _forget(seats, "m")
        _forget(served, "r")
        hot_tables = _hot_sums(moved, len(hot))
        if keep:
            kept.append((tables, customers))
            spellers.append(speller)
            mean_hot += hot_tables / samples
        state, seats = served, moved
    rule = Rule(deal, of_pair, of_word, kept, hot_counts, mean_hot)
    answers = _cut(_grouped([words, _kind(state, "s"), _kind(shops, "k")], _answer_words(rule)), "answers")
    _forget(state, "s", "g")
    _forget(shops, "k")
    pairs = [_kind(shops, "b"), _kind(seats, "t"), _kind(answers, "a")]
    return WordModel(deal, pairs, _kind(answers, "f"), words, tokens, distinct, of_pair, of_word, kept, spellers, hot_counts, mean_hot)


# Scoring.


def _chunks(deal: Deal):
    """Texts in chunks: what each token asks for (kind c), distinct pairs by bucket (q), held-out words by bucket (h)."""

    def flush(held: list) -> pa.RecordBatch:
        number = held[0][0]
        ids = [d for h in held for d in h[1]]
        out = np.concatenate([h[2] for h in held])
        tokens = np.concatenate([h[3].tokens for h in held])
        x, w = np.concatenate([h[3].x for h in held]), np.concatenate([h[3].w for h in held])
        k, apart = pair_key(x, w), np.repeat(out, tokens)
        place, rows, sent = np.zeros(len(k), np.int64), [], {}
        for side, use in enumerate((~apart, apart)):
            u, first, at = distinct(k[use])
            of = x[use][first]
            bucket = deal.of_pairs(of, u)
            order = by_bucket(bucket)
            rank = np.empty(len(u), np.int64)
            rank[order] = np.arange(len(u))
            place[use] = rank[at]
            u, of = u[order], of[order]
            for b, s in _slices(bucket[order]):
                sent.setdefault(b, [np.zeros(0, np.uint64)] * 3)[side] = u[s]
                if side:
                    sent[b][2] = of[s]
        rows += [("q", b, number, pack(*sent[b]), None) for b in sent]
        counts = np.array([(b, len(sent[b][0]), len(sent[b][1])) for b in sorted(sent)], np.int64).reshape(-1, 3)
        u, first, at = distinct(w[apart])
        bucket = deal.of_words(u)
        order = by_bucket(bucket)
        rank = np.empty(len(u), np.int64)
        rank[order] = np.arange(len(u))
        # Words of all groups lie in one array of bytes.
        base = np.repeat(starts_of(np.array([len(h[3].data) for h in held])), [len(h[3].w) for h in held])
        start = (np.concatenate([h[3].start for h in held]) + base)[apart][first][order]
        size = np.concatenate([h[3].size for h in held])[apart][first][order]
        data = np.concatenate([h[3].data for h in held]) if len(u) else np.zeros(0, np.uint8)
        u = u[order]
        rows += [("h", b, number, pack(u[s], slim(size[s]), spans(data, start[s], size[s])), None) for b, s in _slices(bucket[order])]
        null = np.array([d is None for d in ids])
        doc = np.array([d or 0 for d in ids], np.int64)
        rows.append(("c", number, None, pack(doc, null.astype(np.uint8), out.astype(np.uint8), slim(tokens), slim(place), slim(rank[at]), *(slim(counts[:, i]) for i in (1, 2))), None))
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            ids, texts, numbers = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            for g in groups(texts):
                some = ids[at : at + len(g.tokens)]
                held.append((numbers[at], some, np.array([held_out(d) for d in some]), g))
                at += len(g.tokens)
                total += len(g.w)
                if total > CHUNK_TOKENS:
                    yield flush(held)
                    held, total = [], 0
        if held:
            yield flush(held)

    return run


def _answer(rule: Rule, told):
    """A bucket's answers to all chunks: log10 probability and the word's count; a missing pair has none and its context's back-off."""

    def pairs(parts: dict) -> list[tuple]:
        xs, size, back, w, logp, counts = rule.bucket(parts)
        k = pair_key(xs, w, size)
        order = order_of(k)
        k, logp, counts = k[order], logp.astype(np.float32)[order], counts[order]
        out = []
        for src, (train, apart, of) in parts["q"]:
            at, hit = found_in(k, np.concatenate([train, apart]))
            p, c = (np.where(hit, v[at], 0) if len(k) else np.zeros(len(at)) for v in (logp, counts))
            miss = np.flatnonzero(~hit[len(train) :])
            where, known = found_in(xs, of[miss])
            p[len(train) + miss] = np.where(known, back[where], 0.0) if len(xs) else 0.0
            if len(rule.deal.hot):  # a frequent context is known even where this bucket has none of its pairs
                where, known = found_in(rule.deal.hot, of[miss])
                share = (STRENGTH + rule.of_pair * rule.hot_tables) / (STRENGTH + rule.hot_counts)
                p[len(train) + miss] = np.where(known, np.log10(share[where]), p[len(train) + miss])
            out.append(("z", src, key_of(parts), pack(p.astype(np.float32, copy=False), slim(c)), None))
        return out

    def words(parts: dict) -> list[tuple]:
        w, c, p1 = parts["f"][0][1] if "f" in parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
        logp = np.log10(p1.astype(np.float64))
        shares = [math.log10((STRENGTH + rule.of_word * t) / (STRENGTH + k)) for t, k in rule.samples]
        srcs = [src for src, _ in parts["h"]]
        asked, size, data = (_joined(parts["h"], i, kind) for i, kind in enumerate((np.uint64, np.int64, np.uint8)))
        at, hit = found_in(w, asked)
        p, n = (np.where(hit, v[at], 0) if len(w) else np.zeros(len(at)) for v in (logp, c))
        new = np.flatnonzero(~hit)
        spelled = Spelled.of(spans(data, starts_of(size)[new], size[new]), size[new])
        each = [(share + spelled.log(s)) * math.log(10) for share, s in zip(shares, told.value, strict=True)]
        p[new] = (np.logaddexp.reduce(each, axis=0) - math.log(len(each))) / math.log(10)
        bound = np.cumsum([len(a[0]) for _, a in parts["h"]])[:-1]
        return [("z", src, key_of(parts), pack(a.astype(np.float32), slim(b.astype(np.int64))), None) for src, a, b in zip(srcs, np.split(p, bound), np.split(n, bound), strict=True)]

    def key_of(parts: dict) -> int:
        return parts["me"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = _parts(table)
        parts["me"] = key[0].as_py()
        return _table(pairs(parts) if "q" in parts else words(parts) if "h" in parts else [])

    return run


SCORE_DDL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, known_base_score double, known_score double"


def _sum_up(tokens: int, distinct: int, pairs: int):
    """The texts of a chunk, from the answers."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = _parts(table)
        doc, null, out, sizes, place, word, n_train, n_apart = parts["c"][0][1]
        sizes = sizes.astype(np.int64)
        first, apart = starts_of(sizes), np.repeat(out.astype(bool), sizes)
        told = [a for src, a in parts["z"] if src < pairs]
        split = [np.split(v, [n]) for a, n in zip(told, n_train.tolist(), strict=True) for v in a]
        p, c = np.zeros(len(place)), np.zeros(len(place), np.int64)
        for side, use in enumerate((~apart, apart)):
            if use.any():
                p[use] = np.concatenate([s[side] for s in split[::2]])[place[use]]
                c[use] = np.concatenate([s[side].astype(np.int64) for s in split[1::2]])[place[use]]
        words = [(src, a) for src, a in parts["z"] if src >= pairs]
        if words:
            miss = np.zeros(len(place), bool)
            miss[apart] = c[apart] == 0
            of = word[miss[apart]]
            p[miss] += _joined(words, 0, np.float64)[of]
            c[miss] = _joined(words, 1, np.int64)[of]
        base, known = np.log10((c + 1) / (tokens + distinct + 1)), c > 0
        total = lambda v: np.add.reduceat(v, first)
        return pa.table(
            {
                "doc_id": pa.array(doc, pa.int64(), mask=null.astype(bool)), "held_out": out.astype(bool), "n_tokens": sizes, "n_known": total(known.astype(np.int64)),
                "base_score": total(base), "score": total(p), "known_base_score": total(np.where(known, base, 0.0)), "known_score": total(np.where(known, p, 0.0)),
            }
        )

    return run


def _unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without training texts, all words are unseen and scores are zero."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        sizes = [n for g in groups(batch.column(1).to_pylist()) for n in g.tokens.tolist()]
        zeros = pa.array(np.zeros(len(ids)))
        columns = [batch.column(0), pa.array([held_out(d) for d in ids], pa.bool_()), pa.array(sizes, pa.int64()), pa.array(np.zeros(len(ids), np.int64)), zeros, zeros, zeros, zeros]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCORE_DDL.split(", ")])


def score(docs: DataFrame, model: WordModel | None, rounds: int | None = None) -> DataFrame:
    """One row for each text of (id, text): log10 probability by the model and by smoothed word counts."""
    spark, (id_, text) = docs.sparkSession, docs.columns[:2]
    trained = F.lit(model.tokens if model else 0).cast("bigint").alias("train_tokens")
    columns = ["doc_id", "held_out", "n_tokens", "n_known", trained, "base_score", "score", "known_base_score", "known_score"]
    if model is None:
        return cut(docs.select(id_, text).mapInArrow(_unknown, SCORE_DDL), "scores").select(*columns)
    told, rule, out = spark.sparkContext.broadcast(model.spellers), model._rule(), []
    rounds = rounds or ROUNDS
    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    # By what a row holds (its id, and its text's length and beginning): no row depends on how it is read.
    part = F.pmod(F.xxhash64("id", F.octet_length("text"), F.substring("text", 1, 256)), F.lit(rounds))
    for turn in range(rounds):
        some = rows.filter(part == turn)
        asked = _cut(some.mapInArrow(_chunks(model.deal), ROW_DDL), "chunks")
        answers = _cut(_grouped([*model.pairs, model.words, _kind(asked, "q", "h")], _answer(rule, told)), "answers")
        _forget(asked, "q", "h")
        both = _union([t.select("kind", "bucket", "src", "blob") for t in (_kind(asked, "c"), answers)]).groupBy("bucket").applyInArrow(_sum_up(model.tokens, model.distinct, model.deal.pairs), SCORE_DDL)
        out.append(cut(both, "scores"))
        drop_path(spark, asked)
        drop_path(spark, answers)
    return _union(out).select(*columns)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token of held-out and training texts, by the model and by smoothed word counts; also of known and unseen words alone."""
    ten = lambda c, n: F.pow(F.lit(10.0), -F.try_divide(F.sum(c), F.sum(n)))
    known, unseen = F.col("n_known"), F.col("n_tokens") - F.col("n_known")
    pairs = [("", "score", "base_score", F.col("n_tokens")), ("known_", "known_score", "known_base_score", known)]
    of = [x for k, a, b, n in pairs for x in (ten(a, n).alias(f"{k}perplexity"), ten(b, n).alias(f"{k}base_perplexity"))]
    rest = [ten(F.col(a) - F.col(f"known_{a}"), unseen).alias(f"unseen_{k}perplexity") for k, a in (("", "score"), ("base_", "base_score"))]
    return scores.groupBy("held_out").agg(*of, *rest)


def op8_word_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return score(docs, fit(docs))
