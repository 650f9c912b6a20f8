"""Media, archives, classifier and pipeline against plain versions."""

import collections
import gc
import hashlib
import importlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import media_chunks, quality_cotrain, warc_index

sha = lambda b: hashlib.sha256(b).hexdigest()


def plain_cuts(data):
    h, hashes = 0, []
    gear = [int(x) for x in media_chunks.GEAR]
    for b in data:
        h = ((h << 1) + gear[b]) & ((1 << 64) - 1)
        hashes.append(h)
    out, start, n = [], 0, len(data)
    while n - start > media_chunks.LEAST:
        last = min(n, start + media_chunks.MOST)
        start = next((k + 1 for k in range(start + media_chunks.LEAST - 1, last) if (hashes[k] >> 20) & 0xFFF == 0), last)
        out.append(start)
    return out + [n] * (start < n)


def test_cuts_follow_the_rolling_hash_and_the_content():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 200_000).astype(np.uint8).tobytes()
    cuts = media_chunks.gear_cuts(data)
    assert cuts == plain_cuts(data) and len(cuts) > 20
    shifted = media_chunks.gear_cuts(b"some bytes in front" + data)
    assert len({c - 19 for c in shifted} & set(cuts)) > len(cuts) * 0.8
    assert media_chunks.gear_cuts(b"") == [] and media_chunks.gear_cuts(b"x") == [1]
    same = media_chunks.gear_cuts(b"\0" * 200_000)
    assert same == plain_cuts(b"\0" * 200_000) and same[-1] == 200_000


def test_wave_round_trip():
    for n in (64, 128, 6400):
        payload = bytes(range(64)) * (n // 64)
        assert media_chunks.from_wave(media_chunks.to_wave(payload)) == payload
    with pytest.raises(ValueError, match="WAVE"):
        media_chunks.from_wave(media_chunks.to_wave(payload)[:-1])
    import io
    import wave

    with wave.open(io.BytesIO(media_chunks.to_wave(payload))) as w:
        assert (w.getsampwidth(), w.getnchannels(), w.getnframes()) == (1, 1, len(payload))


def _media_rows():
    rnd = random.Random(2)
    shared = "".join(rnd.choice("abcdef ghij") for _ in range(30_000))
    texts = [None, "", "x" * 64, "x" * 65, "é" * 40, shared, shared, "front " + shared, shared + " back", shared[5000:], "\0", "y" * 70_000]
    return [(i, t, "clash") for i, t in enumerate(texts)] + [(None, shared, "c"), (2, "x" * 64, "c")]


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_media_are_rebuilt(spark, broadcast):
    rows = _media_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, media string").repartition(3)
    store = media_chunks.MediaStore(df, most_broadcast=broadcast)
    out = store.report().collect()
    assert len(out) == len(rows)
    expected = []
    for d, t, _ in rows:
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        media = media_chunks.to_wave(payload)
        expected.append((d, len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(media), sha(media), media_chunks.features(payload)))
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, expected))
    stored = store.table.select(F.explode("owned").alias("o")).filter("NOT o").count()
    assert stored > 0 and store.table.count() == len({e[6] for e in expected})
    assert media_chunks.MediaStore(df.limit(0), most_broadcast=broadcast).report().count() == 0


# Archives.


def test_keys_and_records():
    key = warc_index.reversed_host_key
    assert key("http://www.Example.com:80/a/b?x=1#part") == "com,example)/a/b?x=1" and key("https://m.example.org") == "org,example,m)/" and key(None) == ")/"
    assert " " not in key("http://a.b/x y\tz") and key("http://[bad") is not None
    data = warc_index.record(7, "http://a/\r\nX: y", b"body\r\n\r\nmore", "00", None, False)
    headers, block = warc_index.parse(data)
    assert block == b"body\r\n\r\nmore" and headers["warc-type"] == "response" and "x" not in headers
    with pytest.raises(ValueError, match="short"):
        warc_index.parse(data[:-1])


def test_archive_index_and_lookups(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "BLOCK_LINES", 3)
    big = "y" * 2000
    rows = [(i, f"http://host{i % 4}.com/p{i}", big if i % 3 == 0 else f"page {i}") for i in range(30)] + [(90, "http://www.host1.com/p1", "z"), (91, None, None), (None, "http://host1.com/p1", big), (27, "http://host3.com/p27", big)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash")).repartition(4)
    archive = warc_index.CaptureArchive.write(df)
    assert archive.directory.count() == archive.blocks.count() > 8
    found = archive.read(archive.locate(archive.manifest.select("line_key", "capture"))).collect()
    monkeypatch.setattr(warc_index, "SEGMENT_BLOCKS", 4)
    monkeypatch.setattr(warc_index, "SEGMENT_KEYS", 3)
    pieces = archive.read(archive.locate(archive.manifest.select("line_key", "capture"))).collect()
    assert sorted(map(str, found)) == sorted(map(str, pieces)) and len(found) == len(rows)
    for r in found:
        if r.payload_bytes == 2000:
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == 27 else ("revisit", 27))
            assert r.payload_digest == hashlib.sha1(big.encode()).hexdigest()
        else:
            assert r.record_type == "response" and len(r.payload) == r.payload_bytes
    some = archive.lookup(["https://host1.com/p1", "http://nowhere.com/"]).collect()
    assert sorted((r.page_id is None, r.page_id or 0) for r in some) == [(False, 1), (False, 90), (True, 0)]
    assert warc_index.CaptureArchive.write(df.limit(0)).lookup(["http://a.com"]).count() == 0


def test_every_capture_is_found_in_a_large_directory(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "BLOCK_LINES", 1)
    monkeypatch.setattr(warc_index, "SEGMENT_BLOCKS", 50)
    monkeypatch.setattr(warc_index, "SEGMENT_KEYS", 40)
    url = F.when(F.col("id") % 3 == 0, "http://often.com/same").otherwise(F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".com/"), "id"))
    df = spark.range(6000).repartition(5).select(F.col("id").alias("page_id"), url.alias("url"), F.concat(F.lit("page "), "id").alias("html"))
    archive = warc_index.CaptureArchive.write(df)
    assert archive.directory.count() == 6000
    keys = archive.manifest.select("line_key", "capture")
    nowhere = spark.createDataFrame([("com,none)/", 3), (")", 0), ("zz", 5)], keys.schema)
    found = archive.locate(keys.unionByName(keys).unionByName(nowhere))
    assert found.exceptAll(archive.manifest).count() == 0 and found.count() == 6000
    assert archive.lookup(["http://often.com/same"]).agg(F.count("*"), F.countDistinct("page_id")).first()[:] == (2000, 2000)


def test_large_sets_of_equal_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "BROADCAST_BYTES", 0)
    df = spark.range(900).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.com/"), "id").alias("url"), F.when(F.col("id") % 3 == 0, "h" * 1500).otherwise(F.repeat(F.concat("id", F.lit("-")), 400)).alias("html"))
    archive = warc_index.CaptureArchive.write(df)
    out = archive.read(archive.locate(archive.manifest.select("line_key", "capture")))
    assert out.filter("record_type = 'revisit' AND refers_to = 897").count() == 299 and out.filter("record_type = 'response'").count() == 601


# Classifier.


def _labelled(n=400, seed=3):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(20, 200))]
        bad = rnd.random() < 0.3
        if bad:
            words = [w.upper() + "!!" for w in words] if rnd.random() < 0.5 else [f"{w}$$$ |" for w in words]
        text = ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)) if not bad else " ".join(words)
        docs.append((i, text, "en", "shady" if bad and rnd.random() < 0.8 else f"src{i % 3}", len(text)))
        if i % 2:
            labels.append((i, 0 if bad else 1, 0))
    return docs, labels, {d[0]: "$$$" not in d[1] and "!!" not in d[1] for d in docs}


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_held_out_accuracy_and_filter(spark):
    docs, labels, good = _labelled()
    df = spark.createDataFrame(docs, DOCS).withColumn("label", F.lit("clash")).repartition(3)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    out = quality_cotrain.score_documents(df, lab).collect()
    unlabelled = [r for r in out if r.doc_id % 2 == 0]
    assert np.mean([r.kept == good[r.doc_id] for r in unlabelled]) > 0.97
    assert all(r.kept for r in out if good[r.doc_id])
    kept = quality_cotrain.keep_good(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.kept}


def test_calibration_is_plain(spark):
    docs, labels, good = _labelled(600, 5)
    model, _ = quality_cotrain.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    x1 = model.text_view([d[1] for d in docs])
    x2 = np.array([quality_cotrain.meta_features(d[3], d[2]) for d in docs])
    text, meta, both = model.scores(x1, x2)
    truth = np.array([good[d[0]] for d in docs])
    assert text[truth].mean() > 0.9 and text[~truth].mean() < 0.1 and meta[truth].mean() > meta[~truth].mean() and both[truth].min() > both[~truth].max()


def test_words_are_seen(spark):
    """Bad documents differ in their words alone: the same letters, lengths and marks."""
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    swapped = {w: w[::-1] for w in words}
    docs, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        text = [rnd.choice(words) for _ in range(60)]
        text = [swapped[w] if bad and rnd.random() < 0.4 else w for w in text]
        docs.append((i, " ".join(text) + ".", "en", f"src{i % 2}", 0))
        if i % 2:
            labels.append((i, 0 if bad else 1, 0))
    out = quality_cotrain.score_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert np.mean([r.kept == (r.doc_id % 3 != 0) for r in out if r.doc_id % 2 == 0]) > 0.97


def plain_cotraining(docs, labels, held, half):
    """The same co-training on one machine, with matrices of all rows."""
    q = quality_cotrain
    slots = [set(q.word_slots([d[1]])[0].tolist()) for d in docs]
    shares = np.array([np.float32(q.text_features(d[1])) for d in docs], np.float64)
    meta = np.array([np.float32(q.meta_features(d[3], d[2])) for d in docs], np.float64)
    y = np.array([labels.get(d[0], np.nan) for d in docs])
    teaches = ~np.isnan(y) & ~held

    def odds_of(weight, good, group):
        out = []
        for use in (group != 1, group != 0, group > -1):
            n = np.zeros((2, 1 << q.WORD_BITS))
            for i in np.flatnonzero(use & (weight > 0)):
                for w in slots[i]:
                    n[int(good[i]), w] += weight[i]
            n = (n + q.SMOOTH) / (n.sum(1, keepdims=True) + q.SMOOTH * n.shape[1])
            out.append(np.log(n[1] / n[0]))
        return out

    def text_view(odds):
        rows = []
        for i, s in enumerate(slots):
            z = np.array([odds[1 - half[i] if teaches[i] else 2][w] for w in sorted(s)])
            rows.append([z.mean(), np.tanh(z.sum() / 20), (z > 1).mean(), (z < -1).mean()] if len(s) else [0.0] * 4)
        return np.column_stack([shares, rows])

    def sure(model, x):
        p = q.sigmoid(((x - model[0]) / model[1]) @ model[2][1:] + model[2][0])
        return np.isnan(y) & ((p >= q.CONFIDENT) | (p <= 1 - q.CONFIDENT)), p >= 0.5

    odds = odds_of(teaches.astype(float), y >= 0.5, half)
    x = [text_view(odds), meta]
    scale = [(m.mean(0), np.where(m.std(0) > 1e-6, m.std(0), 1.0)) for m in x]
    weights, teach = [np.zeros(m.shape[1] + 1) for m in x], None
    for turn in range(q.ROUNDS):
        if turn:
            pseudo, good = sure(teach[1], meta)
            odds = odds_of(np.where(pseudo, q.PSEUDO_WEIGHT, teaches), np.where(pseudo, good, y >= 0.5), np.where(pseudo, 2, half))
            x = [text_view(odds), meta]
        for _ in range(q.STEPS if turn == 0 else q.STEPS // 2):
            new = []
            for me in (0, 1):
                target, w = np.where(teaches, y, 0.0), teaches.astype(float)
                if teach:
                    pseudo, good = sure(teach[1 - me], x[1 - me])
                    target, w = np.where(pseudo, good, target), np.where(pseudo, q.PSEUDO_WEIGHT, w)
                z = np.column_stack([np.ones(len(y)), (x[me] - scale[me][0]) / scale[me][1]])
                p = q.sigmoid(z @ weights[me])
                penalty = np.full(z.shape[1], q.RIDGE)
                penalty[0] = 1e-6
                curve = z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag(penalty)
                new.append(weights[me] + np.clip(np.linalg.lstsq(curve, z.T @ (w * (target - p)) - penalty * weights[me], rcond=None)[0], -5, 5))
            weights = new
        teach = [(*scale[k], weights[k]) for k in (0, 1)]
    return weights


def test_weights_equal_plain_cotraining(spark):
    docs, labels, _ = _labelled(300, 7)
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    model, rows = quality_cotrain.train(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    marks = {r.doc_id: (r.held, r.half) for r in rows.collect()}
    held, half = np.array([marks[d[0]][0] for d in docs]), np.array([marks[d[0]][1] for d in docs])
    plain = plain_cotraining(docs, {d: q for d, q, _ in labels}, held, half)
    for view, w in zip(model.views, plain, strict=True):
        assert view.weights == pytest.approx(w, abs=1e-4)


def test_threshold():
    bad, good = np.zeros(100), np.zeros(100)
    bad[[3, 10]] = 5
    good[[40, 90]] = 7
    assert 0.10 < quality_cotrain.best_threshold(bad, good) < 0.41
    assert quality_cotrain.best_threshold(np.zeros(100), np.ones(100)) == 0.05 and quality_cotrain.best_threshold(np.ones(100), np.zeros(100)) == 0.5
    bad[60] = 7  # a good document is worth four bad ones
    assert 0.10 < quality_cotrain.best_threshold(bad, good) < 0.41


def test_classifier_without_labels_and_with_nulls(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (1, "x " * 90000, "en", "s", 3)], DOCS)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.kept for r in quality_cotrain.score_documents(df, none).collect()] == [True] * 3
    assert quality_cotrain.keep_good(df, none).count() == 3
    docs, labels, _ = _labelled(200)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    both = spark.createDataFrame(docs, DOCS).unionByName(df)
    assert quality_cotrain.score_documents(both, lab).count() == 203 and quality_cotrain.score_documents(df.limit(0), lab).count() == 0


# Pipeline.


def test_pipeline_stage_by_stage(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    from tests.llm.test_dedup_and_mixing import plain_components

    docs, labels, good = _labelled(160)
    docs = [d for d in docs]
    copies = [(1000 + i, docs[i][1] + "  ", *docs[i][2:]) for i in range(0, 160, 8)]
    near = [(2000 + i, docs[i][1] + " added words", *docs[i][2:]) for i in range(0, 160, 10)]
    df = spark.createDataFrame([*docs, *copies, *near], DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    state = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for name, stage in pipeline.STAGES[:-1]:
        before = state.collect()
        state = stage(spark, state, str(tmp_path))
        assert state.columns == df.columns, name
        after = state.collect()
        sizes.append(len(after))
        if name == "exact dedup":
            groups = collections.defaultdict(list)
            for r in before:
                groups["".join(r.text.split())].append((-len(r.text), r.doc_id))
            assert {r.doc_id for r in after} == {min(g)[1] for g in groups.values()}
        if name == "n-gram Jaccard join":
            parts = plain_components([r.doc_id for r in before], [r.text for r in before])
            assert sorted(r.doc_id for r in after) == sorted(d for d, (_, c) in parts.items() if c == d)
        if name.startswith("quality"):
            assert all(good.get(r.doc_id % 1000, True) for r in after if r.doc_id < 1000)
        if name.startswith("mixing"):
            assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == sizes[-1]
    text = {r.doc_id: r.text for r in df.collect()}
    assert all(r.decoded_sha256 == sha(text[r.doc_id].encode()) for r in out.collect())


def test_stages_of_the_pipeline_begin_with_small_heaps(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs, labels, _ = _labelled(40)
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    state = spark.read.parquet(str(tmp_path / "documents.parquet"))
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    beans = list(jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    held = [jvm.java.nio.ByteBuffer.allocate(64 << 20) for _ in range(12)]
    grown = heap.totalMemory()
    del held
    gc.collect()
    time.sleep(1)  # the other side lets go of them a little later
    for name, stage in pipeline.STAGES:
        before = full()
        stage(spark, state, str(tmp_path))
        assert full() > before, name
    assert heap.totalMemory() < grown
