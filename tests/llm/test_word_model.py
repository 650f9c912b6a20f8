"""The word model against plain counts, enumerated seatings and a customer-by-customer sampler."""

import collections
import itertools
import math
import pathlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrane.llm import word_model

DDL = "doc_id bigint, text string"


def _texts(n=300, seed=8):
    rnd = random.Random(seed)
    parts = ["tion", "er", "the", "an", "in", "re", "ou", "st", "le", "ment"]
    word = lambda: rnd.choice(["the", "of", "and", "a"]) if rnd.random() < 0.4 else "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3)))
    return [(i, " ".join(word() for _ in range(rnd.randint(0, 80)))) for i in range(n)]


def plain_base(rows):
    count = collections.Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode() if d is not None else b"") % 7 != 2:
            count.update(w for w in (t or "").encode().lower().split())
            count[b""] += 1
    total, kinds = sum(count.values()), len(count)
    out = {}
    for d, t in rows:
        words = [*(t or "").encode().lower().split(), b""]
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in words)
        out[d, t] = (zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2, len(words), sum(count[w] > 0 for w in words), total, base)
    return out


def _odd_texts():
    return [*_texts(), (1000, None), (None, "The END"), (1001, "x " * 40000), (1002, ""), (1002, "again again"), (1003, "\xc4\x81\xc9 M\u00fcller \ud55c\uad6d\uc5b4 \x0b\x0c"), (1004, "y" * 70_000), (1005, "the of"), (1006, "the of")]


@pytest.mark.parametrize("small", [False, True])
def test_scores_of_written_tables(spark, monkeypatch, tmp_path, small):
    if small:  # many buckets and chunks, and some words frequent enough to be dealt out
        monkeypatch.setattr(word_model, "BUCKET_BYTES", 6400)
        monkeypatch.setattr(word_model, "TASK_TOKENS", 800)
        monkeypatch.setattr(word_model, "CHUNK_TOKENS", 500)
        monkeypatch.setattr(word_model, "HOT_SHARE", 50)
    rows = _odd_texts()
    spark.createDataFrame([(*r, 1, 2.0) for r in rows], DDL + ", kind int, bucket double").repartition(8).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs")).select("doc_id", "text", "kind", "bucket")
    model = word_model.fit(df.select("doc_id", "text"))
    assert (len(model.deal.hot) > 0) == small and (model.deal.pairs > 8) == small
    out = word_model.score(df, model).collect()
    expected = plain_base(rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out)
    assert got == sorted((d is None, d or 0, *e[:4], round(e[4], 5)) for (d, _), e in expected.items())
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    for side in (True, False):
        assert sum(r.score for r in out if r.held_out == side) > sum(r.base_score for r in out if r.held_out == side)
    assert word_model.perplexity(word_model.score(df, model)).count() == 2
    # After a word, all words and the share of the others have probability one.
    words = {r.w: 10**r.logp for r in model.known_words().collect()}
    assert 0 < sum(words.values()) < 1
    own, back = collections.defaultdict(dict), {}
    for r in model.known_pairs().collect():
        if r.w is None:
            back[r.x] = 10**r.logp
        else:
            own[r.x][r.w] = 10**r.logp
    for x, by in own.items():
        total = sum(by.get(w, back[x] * p) for w, p in words.items())
        assert total + back[x] * (1 - sum(words.values())) == pytest.approx(1.0, abs=1e-5)


def test_scores_do_not_depend_on_partitions_or_rounds(spark):
    rows = _texts(120)
    found = []
    for parts, rounds in ((1, 1), (5, 3)):
        df = spark.createDataFrame(rows, DDL).repartition(parts)
        found.append({r.doc_id: r.score for r in word_model.score(df, word_model.fit(df), rounds).collect()})
    assert found[0] == pytest.approx(found[1], rel=1e-6)


def test_orders_are_stable_whatever_the_keys():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 64, 5000, np.uint64)
    near = (np.uint64(1) << np.uint64(63)) + np.arange(5000, dtype=np.uint64)[::-1]  # they agree in all but their lowest bits
    kinds = [hashes, hashes[rng.integers(0, 900, 5000)], near, rng.integers(0, 50, 5000), np.full(7, word_model.END_ID), np.full(9, 2**64 - 1, np.uint64), hashes[:1], hashes[:0]]
    for keys in kinds:
        assert (word_model.order_of(keys) == np.argsort(keys, kind="stable")).all()
        u, first, place = word_model.distinct(keys)
        assert (np.unique(keys) == u).all() and (keys[first] == u).all() and (u[place] == keys).all()


def test_spelling_is_a_distribution():
    words = [b"the", b"then", b"that", b"cat", b"", b"a"] * 20
    flat, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    keys, starts = word_model.spelling(flat, size)
    assert starts.tolist() == [sum(len(w) + 1 for w in words[:i]) for i in range(len(words))]
    found, count = np.unique(keys, return_counts=True)
    model = None
    for turn in range(3):
        model = word_model.Speller.sample(found, count, model, turn)
    for context in ("   ", " th", "the", "zzz", "\xff9'"):
        start = 0
        for b in context.encode("latin-1"):
            start = start << 5 | int(word_model.CLASS[b])
        assert model.probability((start << 8) + np.arange(256)).sum() == pytest.approx(1.0, abs=1e-9)
    the, het = word_model.log_words(model, np.frombuffer(b"thehet", np.uint8), np.array([3, 3]))
    assert the > het


def test_spelling_is_that_of_a_plain_loop(monkeypatch):
    rnd = random.Random(2)
    words = [bytes(rnd.choices(b"abz09.\xc3\xa9\xed\x95\x9c", k=rnd.choice([0, 1, 2, 3, 9]))) for _ in range(70_000)]
    expected, starts = [], []
    for w in words:
        starts.append(len(expected))
        padded = bytes([word_model.END] * word_model.CONTEXT) + w + bytes([word_model.END])
        for i in range(word_model.CONTEXT, len(padded)):
            context = 0
            for b in padded[i - word_model.CONTEXT : i]:
                context = context << 5 | int(word_model.CLASS[b])
            expected.append(context << 8 | padded[i])
    flat, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    keys, start = word_model.spelling(flat, size)
    assert keys.tolist() == expected and start.tolist() == starts
    found, count = np.unique(keys, return_counts=True)
    model = word_model.Speller.sample(found[::2], count[::2], None, 0)
    logs = np.log10(model.probability(np.array(expected)))
    asked = []
    probability = word_model.Speller.probability
    monkeypatch.setattr(word_model.Speller, "probability", lambda self, keys, *level: (asked.append(len(keys)), probability(self, keys, *level))[1])
    assert (word_model.log_words(model, flat, size) == np.add.reduceat(logs, starts)).all()
    assert max(asked) <= len(found)  # each cell is looked up once, however often it is met
    times = np.array([rnd.randrange(5) for _ in words])
    grams = {i: n for _, i, _, _, n in word_model.Spelled.of(flat, size).grams(times)}
    plain = collections.Counter()
    for i, at in enumerate(np.split(keys, starts[1:])):
        for key in at.tolist():
            plain[key] += times[i]
    assert grams == dict(plain)
    none = word_model.Spelled.of(flat[:0], size[:0])
    assert none.log(model).tolist() == [] and none.grams(times[:0]) == []


def test_few_customers_are_drawn_as_by_the_full_table():
    rng = np.random.default_rng(1)
    n, d = 5000, 0.7
    c, parent, others, u = rng.integers(1, 17, n), rng.random(n), rng.integers(0, 900, n), rng.random(n)
    ladder, t = word_model.stirling(d), np.arange(1, 17)
    weight = ladder[c, 1:17] + t * np.log(parent)[:, None] + np.cumsum(np.log(word_model.STRENGTH + d * (others[:, None] + t - 1)), axis=1)
    p = np.cumsum(np.exp(weight - weight.max(axis=1)[:, None]), axis=1)
    expected = np.minimum((p < (u * p[:, -1])[:, None]).sum(axis=1) + 1, c)
    assert (word_model.draw_tables(c, parent, others, d, u) == expected).mean() > 0.999


def test_blobs_are_written_without_dictionaries(spark):
    rows = [("b", i, None, b"same" * 50, None) for i in range(20)]
    table = word_model._cut(spark.createDataFrame(rows, word_model.ROW_DDL), "packed")
    files = list(pathlib.Path(table.terrane_path.removeprefix("file:")).rglob("*.parquet"))
    assert files and [r.blob for r in table.collect()] == [r[3] for r in rows]
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        blob = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema == "blob")
        assert not any("DICTIONARY" in e for e in blob.encodings)


def _seatings(n):
    """All ways to seat n customers, as sizes of their tables."""
    if n == 0:
        yield []
        return
    for sizes in _seatings(n - 1):
        yield [*sizes, 1]
        for i in range(len(sizes)):
            yield [*sizes[:i], sizes[i] + 1, *sizes[i + 1 :]]


@pytest.mark.parametrize(("c", "parent", "others"), [(2, 0.3, 0), (5, 0.02, 7), (6, 0.6, 40)])
def test_tables_are_drawn_from_all_seatings(c, parent, others):
    d, weights = 0.4, collections.Counter()
    for sizes in _seatings(c):
        w = parent ** len(sizes)
        for k, size in enumerate(sizes):
            w *= word_model.STRENGTH + d * (others + k)
            for j in range(1, size):
                w *= j - d
        weights[len(sizes)] += w
    n = 40_000
    u = word_model.chance(np.arange(n, dtype=np.uint64), 3)
    drawn = word_model.draw_tables(np.full(n, c), np.full(n, parent), np.full(n, others), d, u)
    for t, w in weights.items():
        assert (drawn == t).mean() == pytest.approx(w / sum(weights.values()), abs=0.01)


@pytest.mark.parametrize(("parent", "others", "discount"), [(0.02, 60, 0.3), (0.3, 0, 0.8), (0.001, 5000, 0.8), (0.05, 4000, 0.75), (0.9, 100_000, 0.6)])
def test_many_customers(monkeypatch, parent, others, discount):
    n, c = 4000, 900
    args = (np.full(n, c), np.full(n, parent), np.full(n, others), discount, (np.arange(n) + 0.5) / n)
    exact = word_model.draw_tables(*args)
    monkeypatch.setattr(word_model, "LADDER", 256)
    word_model.stirling.cache_clear()
    saddle = word_model.draw_tables(*args)
    word_model.stirling.cache_clear()
    assert saddle.mean() == pytest.approx(exact.mean(), rel=0.03)
    assert saddle.std() == pytest.approx(exact.std(), rel=0.1, abs=0.1)
    assert word_model.draw_tables(np.array([0, 1]), np.ones(2), np.zeros(2), 0.5, np.array([0.5, 0.5])).tolist() == [0, 1]


class PlainSampler:
    """Two levels of Chinese restaurants over a fixed base, one customer removed and seated at a time."""

    def __init__(self, pairs, base, of_pair, of_word, seed):
        self.rnd, self.base, self.d2, self.d1 = random.Random(seed), base, of_pair, of_word
        self.tables = {x: collections.defaultdict(list) for x, _ in pairs}
        self.words = collections.defaultdict(list)
        self.pairs = pairs
        for x, w in pairs:
            self.add(x, w)

    def p1(self, w):
        k, t = sum(map(sum, self.words.values())), sum(map(len, self.words.values()))
        own = max(0, sum(self.words[w]) - self.d1 * len(self.words[w]))
        return (own + (1 + self.d1 * t) * self.base[w]) / (1 + k)

    def p2(self, x, w):
        k, t = sum(map(sum, self.tables[x].values())), sum(map(len, self.tables[x].values()))
        own = sum(self.tables[x][w]) - self.d2 * len(self.tables[x][w])
        return (own + (1 + self.d2 * t) * self.p1(w)) / (1 + k)

    def seat(self, tables, new, d):
        weights = [new, *(n - d for n in tables)]
        i = self.rnd.choices(range(len(weights)), weights)[0]
        if i:
            tables[i - 1] += 1
        else:
            tables.append(1)
        return i == 0

    def add(self, x, w):
        here = sum(map(len, self.tables[x].values()))
        if self.seat(self.tables[x][w], (1 + self.d2 * here) * self.p1(w), self.d2):
            self.seat(self.words[w], (1 + self.d1 * sum(map(len, self.words.values()))) * self.base[w], self.d1)

    def leave(self, tables):
        i = self.rnd.choices(range(len(tables)), tables)[0]
        tables[i] -= 1
        if not tables[i]:
            del tables[i]
            return True
        return False

    def sweep(self):
        for x, w in self.pairs:
            if self.leave(self.tables[x][w]):
                self.leave(self.words[w])
            self.add(x, w)


def test_probabilities_match_a_customer_by_customer_sampler(spark, monkeypatch):
    rnd = random.Random(5)
    follow = {w: rnd.choices("abcdefgh", k=4) for w in "abcdefgh"}
    rows = []
    for i in range(14):
        text = [rnd.choice("abcdefgh")]
        while len(text) < 14:
            text.append(rnd.choice(follow[text[-1]]))
        rows.append((i, " ".join(text)))
    model = word_model.fit(spark.createDataFrame(rows, DDL), burn=2, samples=10)
    names = {int(word_model.word_id(w).view(np.int64)): w.decode() for w in (b"", *(bytes([c]) for c in b"abcdefgh"))}
    trained = [t.split() for i, t in rows if not word_model.held_out(i)]
    pairs = [p for t in trained for p in itertools.pairwise(["", *t, ""])]
    base = {}
    for w in names.values():
        flat, size = np.frombuffer(w.encode(), np.uint8), np.array([len(w)])
        base[w] = float(np.mean([10 ** word_model.log_words(s, flat, size)[0] for s in model.spellers]))
    plain = PlainSampler(pairs, base, model.of_pair, model.of_word, 3)
    sums, n = collections.Counter(), 300
    for turn in range(n + 30):
        plain.sweep()
        if turn >= 30:
            for p in set(pairs):
                sums[p] += plain.p2(*p) / n
    found = {(names[r.x], names[r.w]): 10**r.logp for r in model.known_pairs().filter("w IS NOT NULL").collect()}
    assert found.keys() == set(pairs)
    assert np.mean([abs(math.log(found[p] / sums[p])) for p in sums]) < 0.05
    assert max(abs(math.log(found[p] / sums[p])) for p in sums) < 0.35


def test_word_model_of_nothing(spark):
    df = spark.createDataFrame([], DDL)
    assert word_model.fit(df) is None and word_model.score(df, None).count() == 0
    held = next(i for i in range(100) if word_model.held_out(i))
    one = spark.createDataFrame([(held, "only held out")], DDL)
    row = word_model.score(one, word_model.fit(one)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (4, 0, 0, 0.0, 0.0)
    other = next(i for i in range(100) if not word_model.held_out(i))
    blank = spark.createDataFrame([(other, None), (other, "")], DDL)
    assert [(r.n_tokens, r.n_known) for r in word_model.score(blank, word_model.fit(blank)).collect()] == [(1, 1), (1, 1)]
    assert word_model.score(df, word_model.fit(blank)).count() == 0


def test_word_order_counts(spark):
    rnd = random.Random(4)
    chain = {w: rnd.sample(range(40), 2) for w in range(40)}
    rows = []
    for i in range(400):
        w = [rnd.randrange(40)]
        while len(w) < 40:
            w.append(rnd.choice(chain[w[-1]]))
        rows.append((i, " ".join(f"word{x}" for x in w)))
    mixed = [(i, " ".join(rnd.sample(t.split(), 40))) for i, t in rows]
    model = word_model.fit(spark.createDataFrame(rows, DDL).repartition(3))
    held = {i for i, _ in rows if word_model.held_out(i)}
    per_token = {}
    for name, texts in (("plain", rows), ("mixed", mixed)):
        out = word_model.score(spark.createDataFrame(texts, DDL), model).filter("held_out").collect()
        assert {r.doc_id for r in out} == held
        per_token[name] = sum(r.score for r in out) / sum(r.n_tokens for r in out)
    # Two words can follow each word: about one bit a word, against log2(40) without the order.
    assert per_token["plain"] > -0.6 and per_token["mixed"] < -1.2


def test_unseen_words_are_spelled(spark):
    rows = _texts(400)
    model = word_model.fit(spark.createDataFrame(rows, DDL))
    words = {w for _, t in rows for w in t.split()}
    like = next(a + b + c + d for a in ("tion", "ment") for b in ("er", "le") for c in ("the", "st") for d in ("in", "ou") if a + b + c + d not in words)
    texts = [(1, " ".join(["of", "the"] * 10)), (2, " ".join(["zqxjv", "kqzzw"] * 10)), (3, like), (4, "zq" * (len(like) // 2)), (5, "z" * 70_000), (6, "")]
    # All of them are held out, or a training text's pairs would be missing from the model.
    ids = [i for i in range(5000, 6000) if word_model.held_out(i)][: len(texts)]
    texts = [(i, t) for i, (_, t) in zip(ids, texts, strict=True)]
    got = {r.doc_id: r for r in word_model.score(spark.createDataFrame(texts, DDL), model).collect()}
    out = {n: got[i] for n, i in enumerate(ids, 1)}
    assert out[1].score / out[1].n_tokens > out[2].score / out[2].n_tokens + 2
    assert out[3].score > out[4].score + 3
    assert all(math.isfinite(r.score) for r in out.values()) and out[5].score < -70_000
    assert out[1].known_score == out[1].score and (out[2].n_known, out[6].known_score) == (1, out[6].score)
    assert out[2].known_base_score == pytest.approx(out[6].base_score)


def test_training_scores_of_repeated_texts_stand_apart(spark):
    rnd = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "rstvxz"]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=60))) for i in range(300)]
    twice = [i for i, _ in rows[:30]]
    rows += [(1000 + i, rows[i][1]) for i in twice]
    df = spark.createDataFrame(rows, DDL)
    out = {r.doc_id: r for r in word_model.score(df, word_model.fit(df)).collect()}
    for side in (False, True):
        rate = lambda ids: [out[i].score / out[i].n_tokens for i in ids if out[i].held_out == side]  # noqa: B023, E731
        both = [i for i in twice if not (out[i].held_out and out[1000 + i].held_out)]
        if rate(both):
            assert np.mean(rate(both)) > np.mean(rate(range(30, 300))) + 0.2


def test_frequent_words_in_a_plain_table(spark):
    rows = [(i, "common " * 50 + f"w{i}") for i in range(100)]
    df = spark.createDataFrame(rows, DDL)
    out = word_model.score(df, word_model.fit(df))
    expected = plain_base(rows)
    assert {(r.doc_id, r.n_known, round(r.base_score, 6)) for r in out.collect()} == {(d, e[2], round(e[4], 6)) for (d, _), e in expected.items()}
    assert out.agg(F.max("score")).first()[0] < 0
