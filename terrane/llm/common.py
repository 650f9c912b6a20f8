"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and normalisation rules, and a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast only if its counted rows times its row size stay below this.
BROADCAST_BYTES = 64 << 20


#: Rows of an Arrow batch: texts are long, and a worker holds a batch several times over.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has chosen a size itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def give_back() -> None:
    """Return freed memory to the system, where the C library can; workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function over batches that gives memory back at the end of its task."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def tidy_group(run: Callable) -> Callable:
    """A function over one group that gives memory back after large groups."""

    @functools.wraps(run)
    def group(key, table):
        large = table.nbytes > 1 << 20
        try:
            return run(key, table)
        finally:
            del table
            if large:
                give_back()

    return group


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def few(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows and the size of a row allow it."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def keep_without(docs: DataFrame, dropped: DataFrame, keys: dict, rows: int, row_bytes: int = 64) -> DataFrame:
    """The rows of ``docs`` that ``dropped`` does not name. keys: column of dropped -> expression on docs.

    A small counted ``dropped`` is broadcast, so texts are not shuffled; a large one is a shuffled anti-join.
    """
    names = free_names(docs.columns, *(f"key_{k}" for k in keys))
    named = docs.withColumns(dict(zip(names, keys.values(), strict=True)))
    rights = free_names(named.columns, *(f"other_{k}" for k in keys))
    right = dropped.select(*[F.col(k).alias(r) for k, r in zip(keys, rights, strict=True)])
    on = [F.col(f"`{n}`").eqNullSafe(F.col(f"`{r}`")) for n, r in zip(names, rights, strict=True)]
    return named.join(few(right, rows, row_bytes), on, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


# Hashes of words.

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BLANKS = _BLANK.tobytes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: A random number for each byte value (blanks weigh nothing), and an odd base with its inverse modulo 2^64.
_WEIGHT = np.array([0 if _BLANK[b] else xxhash.xxh3_64_intdigest(bytes([b]), seed=5) for b in LOWER], np.uint64)
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 19)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of the bytes starts and ends, and its hash: differences of one running sum, moved to the origin."""
    blank = np.frombuffer(data.tobytes().translate(_BLANKS), bool)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edge = np.concatenate(([0], edge)) if len(data) and not blank[0] else edge
    edge = np.append(edge, len(data)) if len(edge) % 2 else edge
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers_to(len(data))
    total = _WEIGHT[data]
    total *= power[: len(data)]
    np.cumsum(total, out=total)
    before = np.where(start > 0, total[start - 1], np.uint64(0)) if len(start) else np.zeros(0, np.uint64)
    return start, end, mix((total[end - 1] - before) * inverse[start] + (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
