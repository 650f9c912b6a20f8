"""Document quality by co-training of two views.

One classifier sees the text: its distinct words, hashed to slots, and the shares of character classes, loud words,
repeats and lines. The other sees the page metadata: source and language. In each round both are fitted on the labelled
rows and on the rows that the other view is confident about, then label the unlabelled rows anew. In the text view a
naive Bayes table gives each slot its evidence, and a logistic regression weighs this evidence and the shares; evidence
for a labelled row comes from the other half of the labels, so no row speaks for itself. A fifth of the labels is held
back: on it each view is calibrated, the calibrated views are combined into one probability, which scores every
document, and the threshold to stay is chosen, a good document dropped costing MERCY times a bad one kept.

Words and shares of all documents are written once; every fitting step is one pass over them that sums counts, or
gradients and curvature, per partition, so all rows take part and the driver holds only tables and matrices of the size
of the features. At most MOST_LABELS labels are used, those with the smallest hashes of their ids; they are broadcast.

Cases. A null text counts as empty, null metadata are values of their own. Labels that are null are ignored, several
for one id are averaged; a null id has no label. Without labels of both kinds every document scores 1 and stays.
Very long texts are read whole. Repeated rows are scored one by one, alike. Columns named like ours are safe: only the
named ones are read. Empty tables give empty results.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import small_batches, tidy, word_hashes
from terrane.session import cut, drop_path

#: Rounds of exchange, probability from which a pseudo-label counts as confident, and its weight.
ROUNDS, CONFIDENT, PSEUDO_WEIGHT = 3, 0.98, 0.2
#: Newton steps of a fit, ridge, share of the labels for calibration (one in HELD), cost of a good document dropped.
STEPS, RIDGE, HELD, MERCY = 6, 1.0, 5, 4.0
#: Hash slots of the sources (each source takes two) and of the languages; bits of the word slots and their smoothing.
SOURCES, LANGUAGES, WORD_BITS, SMOOTH = 128, 8, 16, 0.5
#: Labels that are used at most, and steps of the scale on which the threshold is chosen.
MOST_LABELS, SCALE = 1_000_000, 1000

_CLASS = np.zeros(256, np.int64)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"!", b"|", b"*#$%&@^~+=<>{}[]\\/_", b".,;:?", b"-'\"()"), 1):
    _CLASS[list(_set)] = _i
_CLASS[128:] = 11
CLASSES = 12


def text_features(text: str) -> list[float]:
    """Shares between 0 and 1 and their square roots, which tell small shares apart."""
    data = text.encode("utf-8", "surrogatepass")
    shares = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=CLASSES)[:CLASSES] / max(1, len(data))
    words = text.split()
    lines = text.split("\n")
    n = max(1, len(words))
    loud = sum(w.isupper() and len(w) > 1 for w in words) / n
    bare = sum(not w[0].isalnum() for w in words) / n
    ending = sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in words) / n
    again = sum(map(operator.eq, words, words[1:])) / n
    distinct = len(set(words)) / n
    few = sum(len(x) < 20 for x in lines) / len(lines)
    own = len(set(lines)) / len(lines)
    odd = sum(max(x.count("|") + x.count("!"), 0) * 12 > len(x) for x in lines) / len(lines)
    length = sum(map(len, words)) / n
    basic = [*shares.tolist(), loud, bare, ending, again, distinct, few, own, odd]
    return [*basic, *(x**0.5 for x in basic), min(length, 30.0) / 10, float(len(words) == 0)]


def word_slots(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct slots of its lower-cased words."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        group.append(text.encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= 1 << 18 or i + 1 == len(texts):
            start, _, h = word_hashes(np.frombuffer(b"\n".join(group) + b"\n", np.uint8))
            bound = np.searchsorted(start, np.cumsum([0, *(len(g) + 1 for g in group)]))
            of = np.repeat(np.arange(len(group)), np.diff(bound))
            keys = np.unique(of << WORD_BITS | (h >> np.uint64(64 - WORD_BITS)).astype(np.int64))
            ends = np.searchsorted(keys >> WORD_BITS, np.arange(len(group) + 1))
            out += [(keys[a:b] & (1 << WORD_BITS) - 1).astype(np.int32) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            group, size = [], 0
    return out


def meta_features(source: str | None, lang: str | None) -> list[float]:
    out = [0.0] * (SOURCES + LANGUAGES)
    spot = xxhash.xxh3_64_intdigest(repr(source).encode("utf-8", "surrogatepass"))
    out[spot % (SOURCES // 2)] = out[SOURCES // 2 + (spot >> 32) % (SOURCES // 2)] = 1.0
    out[SOURCES + xxhash.xxh3_64_intdigest(repr(lang).encode("utf-8", "surrogatepass")) % LANGUAGES] = 1.0
    return out


def evidence(words: np.ndarray, size: np.ndarray, odds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What the words of each row say: their mean and summed log odds, and the shares that speak clearly for and against.

    words: slots of all rows, size: of each row, table: which of the odds counts for a row.
    """
    z = odds[np.repeat(table, size), words]
    start = np.minimum(np.cumsum(size) - size, max(0, len(z) - 1))
    add = lambda v: np.where(size > 0, np.add.reduceat(v, start), 0.0) if len(z) else np.zeros(len(size))
    n, total = np.maximum(size, 1), add(z)
    return np.column_stack([total / n, np.tanh(total / 20), add((z > 1).astype(np.float64)) / n, add((z < -1).astype(np.float64)) / n])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, source, lang = (batch.column(i).to_pylist() for i in (1, 2, 3))
        text = [t or "" for t in text]
        kind = pa.list_(pa.float32())
        columns = [pa.array(word_slots(text), pa.list_(pa.int32())), pa.array([text_features(t) for t in text], kind), pa.array([meta_features(*x) for x in zip(source, lang, strict=True)], kind)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(4), batch.column(5), batch.column(6)], names=["doc_id", "words", "text_view", "meta_view", "label", "held", "half"])


SHARES, WORDS = len(text_features("")), 4
TEXT_SIZE, META_SIZE = SHARES + WORDS, len(meta_features(None, None))


@dataclass
class Scaled:
    """Linear scores of features scaled to mean 0 and deviation 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class CoTrained:
    views: tuple[Scaled, Scaled]
    platt: tuple[np.ndarray, np.ndarray]
    combine: np.ndarray
    odds: np.ndarray
    keep: float = 0.5

    def text_view(self, texts: list[str]) -> np.ndarray:
        """Features of new texts."""
        slots = word_slots(texts)
        size = np.array([len(x) for x in slots], np.int64)
        flat = np.concatenate(slots) if slots else np.zeros(0, np.int32)
        shares = np.array([text_features(t) for t in texts], np.float32).astype(np.float64).reshape(-1, SHARES)
        return np.column_stack([shares, evidence(flat, size, self.odds, np.full(len(size), 2))])

    def scores(self, x1: np.ndarray, x2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by the text, by the metadata, and by both."""
        z = [a + b * v(x) for (a, b), v, x in zip(self.platt, self.views, (x1, x2), strict=True)]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(self.combine[0] + self.combine[1] * z[0] + self.combine[2] * z[1])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _labels(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Label of each row (nan for none), and whether it may teach."""
    label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
    return label, ~np.isnan(label) & ~batch.column("held").to_numpy(zero_copy_only=False).astype(bool)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("words")
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _views(batch: pa.RecordBatch, odds: np.ndarray, cross: bool = True) -> list[np.ndarray]:
    """Both views of a batch; with ``cross``, rows that teach get evidence from the other half of the labels."""
    table = np.full(batch.num_rows, 2)
    if cross:
        _, teaches = _labels(batch)
        half = batch.column("half").to_numpy(zero_copy_only=False).astype(np.int64)
        table = np.where(teaches, 1 - half, 2)
    words, size = _words(batch)
    return [np.column_stack([_matrix(batch.column("text_view"), SHARES), evidence(words, size, odds, table)]), _matrix(batch.column("meta_view"), META_SIZE)]


#: Numbers of a vector that travel together when vectors are summed, and vectors that one task adds up.
PIECE, FAN = 1 << 14, 64


def _summed(df: DataFrame, per_batch, size: int) -> np.ndarray:
    """Sum of per_batch's vectors over all rows; each partition sends one, in pieces that are added up in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total += per_batch(batch)
                seen = True
        if seen:
            pieces = [total[i : i + PIECE].tobytes() for i in range(0, size, PIECE)]
            mine = pa.array([TaskContext.get().partitionId()] * len(pieces), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), mine, pa.array(pieces, pa.binary())], names=["i", "p", "v"])

    out, ddl, parts = np.zeros(size), "i int, p bigint, v binary", df.rdd.getNumPartitions()
    found = df.mapInArrow(tidy(run), ddl)
    while parts > 1:
        found, parts = found.withColumn("p", F.floor(F.col("p") / FAN)).groupBy("i", "p").applyInArrow(_added, ddl), -(-parts // FAN)
    for r in found.collect():
        out[r.i * PIECE : (r.i + 1) * PIECE] = np.frombuffer(r.v)
    return out


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v) for v in table.column("v").to_pylist())
    return pa.table({"i": table.column("i")[:1], "p": table.column("p")[:1], "v": pa.array([total.tobytes()], pa.binary())})


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the weighted log loss, as one vector."""
    x = np.column_stack([np.ones(len(x)), x])
    p = sigmoid(x @ weights)
    return np.concatenate([x.T @ (w * (y - p)), ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()])


def _step(total: np.ndarray, weights: np.ndarray, ridge: float) -> np.ndarray:
    d = len(weights)
    penalty = np.full(d, ridge)
    penalty[0] = 1e-6
    gradient, curve = total[:d] - penalty * weights, total[d:].reshape(d, d) + np.diag(penalty)
    return weights + np.clip(np.linalg.lstsq(curve, gradient, rcond=None)[0], -5, 5)


class CoTraining:
    """Fits both views on a table of features with a label column (null where unknown)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def _scales(self, odds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        def part(batch):
            return np.concatenate([[batch.num_rows], *(v for m in _views(batch, odds) for v in (m.sum(0), (m * m).sum(0)))])

        total = _summed(self.rows.drop("doc_id"), part, 1 + 2 * (TEXT_SIZE + META_SIZE))
        n, at, out = max(1.0, total[0]), 1, []
        for size in (TEXT_SIZE, META_SIZE):
            mean = total[at : at + size] / n
            scale = np.sqrt(np.maximum(total[at + size : at + 2 * size] / n - mean * mean, 0))
            out.append((mean, np.where(scale > 1e-6, scale, 1.0)))
            at += 2 * size
        return out

    def _odds(self, meta: Scaled | None) -> np.ndarray:
        """Log odds of each word slot, from labels of either half and of both, and rows that the metadata are confident about."""
        slots = 1 << WORD_BITS

        def part(batch):
            label, teaches = _labels(batch)
            words, size = _words(batch)
            half = batch.column("half").to_numpy(zero_copy_only=False).astype(np.int64)
            weight, good = teaches.astype(np.float64), np.where(teaches, label, 0.0) >= 0.5
            cell = half
            if meta is not None:
                p = sigmoid(meta(_matrix(batch.column("meta_view"), META_SIZE)))
                sure = np.isnan(label) & ((p >= CONFIDENT) | (p <= 1 - CONFIDENT))
                weight, good, cell = np.where(sure, PSEUDO_WEIGHT, weight), np.where(sure, p >= 0.5, good), np.where(sure, 2, half)
            use = weight > 0
            each, size = np.repeat(use, size), size[use]
            cell = (2 * cell[use] + good[use]).astype(np.int64)
            return np.bincount(np.repeat(cell, size) * slots + words[each], np.repeat(weight[use], size), 6 * slots)

        count = _summed(self.rows.select("words", "meta_view", "label", "held", "half"), part, 6 * slots).reshape(3, 2, slots)
        out = []
        for c in (count[0] + count[2], count[1] + count[2], count.sum(0)):
            share = (c + SMOOTH) / (c.sum(1, keepdims=True) + SMOOTH * slots)
            out.append(np.log(share[1] / share[0]))
        return np.array(out)

    def fit(self) -> CoTrained | None:
        known = self.rows.filter("label IS NOT NULL AND NOT held").groupBy("label").count().collect()
        if len(known) < 2:
            return None
        sizes = [TEXT_SIZE + 1, META_SIZE + 1]
        odds = self._odds(None)
        scales = self._scales(odds)
        views = [Scaled(m, s, np.zeros(len(m) + 1)) for m, s in scales]
        teach: tuple | None = None
        for turn in range(ROUNDS):
            if turn:
                odds = self._odds(teach[1])
            for _ in range(STEPS if turn == 0 else STEPS // 2):
                now = tuple(views)

                def part(batch, now=now, teach=teach, odds=odds):
                    x = _views(batch, odds)
                    label, labelled = _labels(batch)
                    out = []
                    for me in (0, 1):
                        y, w = np.where(labelled, label, 0.0), labelled.astype(np.float64)
                        if teach is not None:  # what the other view is confident about, of rows without a label
                            p = sigmoid(teach[1 - me](x[1 - me]))
                            sure = np.isnan(label) & ((p >= CONFIDENT) | (p <= 1 - CONFIDENT))
                            y, w = np.where(sure, p >= 0.5, y).astype(np.float64), np.where(sure, PSEUDO_WEIGHT, w)
                        use = w > 0
                        z = (x[me][use] - now[me].mean) / now[me].scale
                        out.append(_newton(z, y[use], w[use], now[me].weights))
                    return np.concatenate(out)

                total = _summed(self.rows.drop("doc_id"), part, sum(d + d * d for d in sizes))
                cutoff = sizes[0] + sizes[0] ** 2
                views = [Scaled(v.mean, v.scale, _step(t, v.weights, RIDGE)) for v, t in zip(views, (total[:cutoff], total[cutoff:]), strict=True)]
            teach = tuple(views)
        return self._calibrate(tuple(views), odds)

    def _calibrate(self, views: tuple[Scaled, Scaled], odds: np.ndarray) -> CoTrained:
        rows = self.rows.filter("label IS NOT NULL AND held").drop("doc_id")
        platt = [np.array([0.0, 1.0]), np.array([0.0, 1.0])]
        combine = np.array([0.0, 1.0, 0.0])

        def raw(batch):
            return [v(m) for v, m in zip(views, _views(batch, odds), strict=True)], _labels(batch)[0]

        for _ in range(STEPS):

            def part(batch, platt=tuple(platt)):
                z, y = raw(batch)
                return np.concatenate([_newton(s[:, None], y, np.ones(len(y)), p) for s, p in zip(z, platt, strict=True)])

            total = _summed(rows, part, 12)
            platt = [self._platt(_step(t, p, 0.05)) for t, p in zip((total[:6], total[6:]), platt, strict=True)]
        for _ in range(STEPS):

            def part(batch, combine=combine):
                z, y = raw(batch)
                return _newton(np.column_stack([p[0] + p[1] * s for s, p in zip(z, platt, strict=True)]), y, np.ones(len(y)), combine)

            combine = _step(_summed(rows, part, 12), combine, 0.05)
        model = CoTrained(views, tuple(platt), combine, odds)

        def part(batch):
            step = np.minimum((model.scores(*_views(batch, odds))[2] * SCALE).astype(np.int64), SCALE - 1)
            return np.bincount((_labels(batch)[0] >= 0.5) * SCALE + step, minlength=2 * SCALE).astype(np.float64)

        model.keep = best_threshold(*_summed(rows, part, 2 * SCALE).reshape(2, SCALE))
        return model

    @staticmethod
    def _platt(p: np.ndarray) -> np.ndarray:
        """A view may be ignored but not turned round."""
        return np.array([p[0], max(p[1], 0.0)])


def best_threshold(bad: np.ndarray, good: np.ndarray) -> float:
    """The middle of the thresholds with the least cost, from counts of scores; at least 0.05 and at most 0.5."""
    cost = bad.sum() - np.concatenate(([0], np.cumsum(bad))) + MERCY * np.concatenate(([0], np.cumsum(good)))
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    return float(np.clip((best[0] + best[-1]) / 2 / len(bad), 0.05, 0.5))


FEATURES_DDL = "doc_id bigint, words array<int>, text_view array<float>, meta_view array<float>, label double, held boolean, half int"


def feature_table(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", source_col="source", lang_col="lang") -> DataFrame:
    """Words, shares and metadata of every document, with its label. labels: doc_id, quality."""
    given = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("l_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    given = F.broadcast(given.orderBy(F.xxhash64("l_id"), "l_id").limit(MOST_LABELS))  # sixteen bytes a row
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
    )
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(2 * HELD)).cast("int")
    known = rows.join(given, F.col("doc_id") == F.col("l_id"), "left").select("doc_id", "text", "source", "lang", "label", (mark % HELD == 0).alias("held"), (mark % 2).alias("half"))
    return known.mapInArrow(tidy(_features), FEATURES_DDL)


def train(docs: DataFrame, labels: DataFrame, **columns: str) -> tuple[CoTrained | None, DataFrame]:
    """The co-trained classifier, and the written features of all documents."""
    small_batches(docs.sparkSession)
    rows = cut(feature_table(docs, labels, **columns), "quality-features")
    return CoTraining(rows).fit(), rows


def _score(model: CoTrained | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [np.ones(batch.num_rows)] * 3 if model is None else model.scores(*_views(batch, model.odds, cross=False))
            kept = found[2] >= (0 if model is None else model.keep)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f) for f in found), pa.array(kept)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) of every document."""
    model, rows = train(docs, labels)
    return rows.mapInArrow(_score(model), "doc_id bigint, text_score double, meta_score double, score double, kept boolean")


def _filter(model: CoTrained, at: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text, source, lang = (batch.column(i).to_pylist() for i in at)
                x2 = np.array([meta_features(None if s is None else str(s), None if g is None else str(g)) for s, g in zip(source, lang, strict=True)])
                yield batch.filter(pa.array(model.scores(model.text_view([t or "" for t in text]), x2)[2] >= model.keep))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, text_col="text", source_col="source", lang_col="lang") -> DataFrame:
    """The documents that the classifier keeps, all columns kept."""
    model, rows = train(docs, labels, text_col=text_col, source_col=source_col, lang_col=lang_col)
    drop_path(docs.sparkSession, rows)
    if model is None:
        return docs
    at = [docs.columns.index(c) for c in (text_col, source_col, lang_col)]
    return docs.mapInArrow(tidy(_filter(model, at)), docs.schema)


def op5_quality_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
