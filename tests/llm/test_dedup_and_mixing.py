"""Exact and near duplicates, and mixing, against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import exact_dedup, mixing, ngram_join

BLANK = re.compile(r"[\x20\x09-\x0D]")


def test_exact_groups(spark):
    texts = ["a b", "ab", "a  b", None, "", "\t\n", "c", "c", "a b", "x" * 50000]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(6, "c", "clash", 1), (None, "zz", "", 2), (None, "zz", "", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest string, points int").repartition(3)
    out = exact_dedup.exact_dedup_report(df).collect()
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), d is None, d if d is not None else 0))
    assert len(out) == len(rows) and sum(r.kept for r in out) == len(groups)
    by = {(r.doc_id, r.text_sha256): r for r in out}
    for d, t, *_ in rows:
        norm = BLANK.sub("", t or "")
        r = by[d, hashlib.sha256(norm.encode()).hexdigest()]
        best = min(groups[norm])
        assert r.group_size == len(groups[norm]) and r.keep_id == (None if best[1] else best[2])
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0 and exact_dedup.exact_dedup_report(df.limit(0)).count() == 0


@pytest.mark.parametrize("names", [("__id", "__digest", "__points"), ("key_id", "KEY_DIGEST", "other_id"), ("id", "best", "row"), ("copies", "own", "place")])
def test_columns_of_any_name_and_string_ids(spark, names):
    rows = [("b", "x y", "s", 1, 2, 3), ("a", "x  y", "s", 4, 5, 6), ("a", "x  y", "t", 7, 8, 9), (None, "xy", None, 1, 1, 1), ("c", "other words here", "s", 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, " + ", ".join(f"{n} int" for n in names))
    before = set(t.name for t in spark.catalog.listTables())
    report = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup_report(df).collect()}
    assert report == {("b", "a", 4), ("a", "a", 4), (None, "a", 4), ("c", "c", 1)}
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == ["a", "c"]
    assert set(t.name for t in spark.catalog.listTables()) == before
    numbered = df.withColumn("doc_id", F.monotonically_increasing_id())
    assert ngram_join.drop_near_duplicates(numbered).columns == df.columns
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns and mixed.count() > 0


def test_index_persists_and_grows(spark):
    docs = lambda *t: exact_dedup.fingerprints(spark.createDataFrame(list(t), "doc_id bigint, text string"))
    index = exact_dedup.DigestIndex(spark, buckets=4)
    assert index.add(docs((1, "a"), (2, "b"), (3, "a "))).filter("fresh").count() == 2
    again = exact_dedup.DigestIndex(spark, path=index.path, name=index.name, buckets=4)
    load = again.add(docs((4, "a  "), (5, "c"))).collect()
    assert sorted(r.fresh for r in load) == [False, True]
    found = {r.best.id: r.rows for r in again.resolve().collect()}
    assert found == {4: 3, 2: 1, 5: 1}
    plan = again.resolve()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = exact_dedup.exact_dedup_report(df)
    assert out.filter("kept").count() == 2001 and out.filter("keep_id = 0 AND group_size = 1000").count() == 1000


# Near duplicates.


def plain_sets(texts):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def plain_components(ids, texts):
    sets, parent = plain_sets(texts), list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = collections.defaultdict(lambda: 1 << 60)
    for i, d in enumerate(ids):
        least[root(i)] = min(least[root(i)], d)
    return {d: (len(sets[i]), least[root(i)]) for i, d in enumerate(ids)}


def corpus(seed):
    """Families of near copies around a base, chains, shared passages, short texts and ties."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 5)))
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n", "one two", "One  TWO", "one two three", "Edge\x0bcase\tof five words", "edge case of FIVE words"]
    for _ in range(6):
        base = [word() for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.randint(1, 25)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rnd.randrange(len(copy))] = word()
            texts.append((" " if rnd.random() < 0.5 else "\n").join(copy))
    chain = [word() for _ in range(50)]
    for i in range(12):
        chain = list(chain)
        chain[i * 4] = word()
        texts.append(" ".join(chain))
    for _ in range(20):
        texts.append(" ".join([*passage, *(word() for _ in range(rnd.choice([2, 5, 8, 12, 40])))]))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_against_all_pairs(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(i * 3, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, node int").repartition(3)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()}
    assert out == plain_components([i * 3 for i in range(len(texts))], texts)


def test_large_families_and_forced_rounds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TASK_MEMBERS", 7)
    monkeypatch.setattr(ngram_join, "TASK_POSTINGS", 5)
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0)
    texts = corpus(4) + corpus(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert ngram_join.NgramJoin(df).salts.max() > 2
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()}
    assert out == plain_components(list(range(len(texts))), texts)


def test_near_filter_and_odd_rows(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (9, None), (7, "something else that is not like it")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("clash"))
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "9", "None"]
    report = ngram_join.near_duplicates(df)
    assert report.filter("doc_id IS NULL").first().component_id is None and report.count() == 6
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0 and ngram_join.drop_near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("rounds", [0, 3])
def test_tiles_of_large_blocks(spark, monkeypatch, rounds):
    """A passage common to many otherwise different documents, and near copies among them."""
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 6)
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(6))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(25):
        own = [word() for _ in range(rnd.choice([6, 8, 9, 10, 14]))]
        texts.append(" ".join(passage + own))
        if rnd.random() < 0.4:
            texts.append(" ".join([*passage, *own[:-1], word()]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    join = ngram_join.NgramJoin(df)
    parts = collections.defaultdict(list)
    for r in join.components(rounds=rounds, eager=0).collect():
        parts[r.label].append(r.node)
    nodes = {ngram_join.node_of(ngram_join.shingle_set(t)): i for i, t in enumerate(texts)}
    plain = collections.defaultdict(list)
    for i, (_, c) in plain_components(list(range(len(texts))), texts).items():
        plain[c].append(i)
    assert sorted(sorted(nodes[n] for n in g) for g in parts.values()) == sorted(sorted(g) for g in plain.values() if len(g) > 1)


def test_rows_with_one_id_are_documents_of_their_own(spark):
    one, two = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, one), (3, one), (3, two), (5, two), (3, two), (7, one + " z"), (4, ""), (4, ""), (8, "u v w x y z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(df).collect())
    assert got == [(1, 1), (3, 1), (3, 3), (3, 3), (4, 4), (4, 4), (5, 3), (7, 1), (8, 8)]
    kept = sorted((r.doc_id, r.text) for r in ngram_join.drop_near_duplicates(df).collect())
    assert kept == [(1, one), (3, two), (4, ""), (4, ""), (8, "u v w x y z")]


def test_divide_skip_counts_exactly():
    rnd = random.Random(6)
    for _ in range(400):
        lists = [sorted(rnd.sample(range(40), rnd.randint(0, 30))) for _ in range(rnd.randint(0, 25))]
        lists = [x for x in lists if x]
        counts = collections.Counter(m for x in lists for m in x)
        for least in (1, 2, 5, 9):
            assert ngram_join.divide_skip(lists, least) == {m: c for m, c in counts.items() if c >= least}


def test_sketches_never_refute_links():
    rnd = random.Random(2)
    for _ in range(500):
        base = [rnd.getrandbits(64) for _ in range(rnd.randint(1, 300))]
        other = base[: rnd.randint(0, len(base))] + [rnd.getrandbits(64) for _ in range(rnd.randint(0, 1 + len(base) // 4))]
        if other:
            a, b = (np.unique(np.array(x, np.uint64)) for x in (base, other))
            o = len(np.intersect1d(a, b))
            if 100 * o >= 75 * (len(a) + len(b) - o):
                assert ngram_join.may_link(len(a), ngram_join.odd_sketch(a), len(b), ngram_join.odd_sketch(b))


# Mixing.


def test_targets():
    assert mixing.fill_targets([10, 10], [1, 1], 15, 2) == [7.5, 7.5]
    capped = mixing.fill_targets([1, 10, 10], [3, 1, 2], 31.5, 2)
    assert capped[0] == 2 and capped[2] == pytest.approx(19.6666, abs=1e-3) and sum(capped) == pytest.approx(31.5)
    assert mixing.fill_targets([0, 0], [1, 1], 0, 2) == [0, 0] and mixing.fill_targets([], [], 0, 2) == []


def test_flow_spreads_repeats_and_fills_quotas():
    flows = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15, "b": 15})
    taken = {p: sum(f.values()) for p, f in flows.items()}
    assert sum(f.get("a", 0) for f in flows.values()) == 15 and sum(f.get("b", 0) for f in flows.values()) == 15
    assert taken == {("a",): 10, ("a", "b"): 10, ("b",): 10}
    more = mixing.route({("a",): 10, ("a", "b"): 10}, {"a": 5, "b": 18})
    assert sum(f.get("b", 0) for f in more.values()) == 18


def brute_flow_cost(patterns, flows):
    cost = 0
    for p, f in flows.items():
        used = sum(f.values())
        cost += min(used, patterns[p]) + 3 * max(0, used - patterns[p])
    return cost


def test_flow_is_cheapest():
    rnd = random.Random(9)
    for _ in range(30):
        patterns = {("a",): rnd.randint(0, 4), ("a", "b"): rnd.randint(0, 4), ("b",): rnd.randint(0, 4)}
        quotas = {"a": rnd.randint(0, 6), "b": rnd.randint(0, 6)}
        flows = mixing.route(patterns, quotas)
        best = None
        for x in range(2 * patterns[("a",)] + 1):
            for y in range(2 * patterns[("b",)] + 1):
                for u in range(2 * patterns[("a", "b")] + 1):
                    for v in range(2 * patterns[("a", "b")] - u + 1):
                        if x + u <= quotas["a"] and y + v <= quotas["b"]:
                            f = {("a",): {"a": x}, ("b",): {"b": y}, ("a", "b"): {"a": u, "b": v}}
                            key = (-(x + y + u + v), brute_flow_cost(patterns, f))
                            best = key if best is None else min(best, key)
        got = (-sum(sum(f.values()) for f in flows.values()), brute_flow_cost(patterns, flows))
        assert got == best


def test_mix_query(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 60)), rnd.choice(["b", "a", "c", None]), i) for i in range(400)] + [(None, "x y", "a", 0), (7, None, "b", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = mixing.op7_mix_sources(spark, str(tmp_path))
    first = sorted(map(str, out.collect()))
    assert first == sorted(map(str, mixing.op7_mix_sources(spark, str(tmp_path)).collect()))
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = dict(zip(["a", "b", "c", None], mixing.fill_targets([sizes[s] for s in ("a", "b", "c", None)], [3, 1, 2, 3], 1.5 * sum(sizes.values()), 2), strict=True))
    got = collections.Counter()
    source = {r[0]: r[2] for r in rows if r[0] != 7}
    for r in out.collect():
        assert r.taken <= 2 * r["size"]
        if r.doc_id in source:
            s = source[r.doc_id]
            got[s] += r.taken
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
    for s in ("a", "c", None):
        assert got[s] == pytest.approx(want[s], abs=30)
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.taken // r["size"] for r in out.collect() if r["size"])
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_documents_stay_where_they_are(spark, tmp_path):
    df = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 3}") for i in range(90)], "doc_id bigint, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for out in (mixing.mix_documents(spark.read.parquet(str(tmp_path / "documents.parquet"))), mixing.op7_mix_sources(spark, str(tmp_path))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_the_gap_is_filled_to_the_end(spark):
    rows = [(i, "w " * (1 if i else 40), "a" if i % 2 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mix, _ = mixing.plan_mix(df, F.array("source"), mixing.word_count(F.col("text")), F.col("doc_id"))
    taken = mixing.apply_mix(df, mix, F.array("source"), F.col("doc_id")).groupBy("source").agg(F.sum(F.col("__copies") * mixing.word_count(F.col("text"))).alias("n"))
    assert {r.source: r.n for r in taken.collect()} == {s: round(t) for s, t in mix.targets.items()}


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(i, ["a"] if i % 2 else ["a", "b"]) for i in range(200)], "id bigint, m array<string>")
    mix, _ = mixing.plan_mix(df, F.col("m"), F.lit(10).cast("bigint"), F.col("id"))
    taken = mixing.apply_mix(df, mix, F.col("m"), F.col("id")).agg(F.sum("__copies") * 10).first()[0]
    assert taken == pytest.approx(sum(mix.targets.values()), abs=20)
