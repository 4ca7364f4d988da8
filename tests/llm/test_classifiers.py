"""Toxicity and quality: gradients, window coverage, held-out accuracy and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from welfarelens.llm import gru, labelled, quality, simhash, toxicity
from welfarelens.llm import workload

ODD = [None, "", "   ", "...!!! 123", "é", "one", "word " * 50_000, "Same text here", "Same text here"]


def small_network():
    net = gru.Network({b"alpha": 1, b"beta": 2}, seed=3)
    words = [b"alpha", b"beta", b"gamma", b"x", "é".encode()]
    x = np.concatenate([net.inputs(*net.features(words)), np.zeros((1, 16), np.float32)])
    ids = np.random.default_rng(0).integers(0, 5, (6, gru.WINDOW))
    ids[0, 3:], ids[1, :] = 5, 5
    return net, x, ids


def test_infer_equals_forward():
    net, x, ids = small_network()
    slow, _ = net.forward(net.project(x), ids, 5)
    table = net.scaled(x)
    np.testing.assert_allclose(net.infer(table, ids, 5), slow, atol=1e-5)


@pytest.mark.parametrize("name", ["Uf", "Ub", "A", "a", "v", "w", "b"])
def test_gradients(name):
    net, x, ids = small_network()
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x = x.astype(float)
    loss = lambda: float((net.forward(net.project(x), ids, 5)[0] * weights).sum())
    weights = np.linspace(-1, 1, len(ids))
    _, state = net.forward(net.project(x), ids, 5, keep=True)
    grads, dprojected = net.backward(weights, ids, state, len(x))
    flat = net.p[name].reshape(-1)
    for i in range(0, len(flat), max(1, len(flat) // 5)):
        old, step = flat[i], 1e-3
        flat[i] = old + step
        up = loss()
        flat[i] = old - step
        down = loss()
        flat[i] = old
        assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * step), abs=2e-3)
    for d in "fb":
        assert dprojected[d].shape == (len(x), 3 * gru.HIDDEN)


def test_windows_cover_every_word():
    lengths = np.array([0, 1, 31, 32, 33, 57, 200])
    document, starts = gru.window_starts(lengths)
    flat = np.arange(lengths.sum())
    rows = gru.window_words(flat, lengths, document, starts, -1)
    assert set(rows.ravel()) - {-1} == set(flat)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    for d, row in zip(document, rows):
        assert set(owner[row[row >= 0]]) <= {d}
    assert set(document) == set(range(len(lengths)))


def test_char_grams_stay_within_words():
    words = [b"a", b"trash", b"trashy", b"a"]
    grams, first = gru.char_grams(words)
    pieces = np.split(grams, first[1:])
    assert pieces[0].tolist() == pieces[3].tolist() and len(pieces[0]) == 1
    assert len(set(pieces[1]) & set(pieces[2])) >= 6


def accuracy(rows):
    held = [r for r in rows if r["held_out"]]
    return np.mean([r["predicted"] == r["label"] for r in held]), len(held)


@pytest.mark.parametrize("name,label,least", [("op5_toxicity", "toxic", 0.9), ("op6_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    scored = workload.QUERIES[name](spark, sf)
    labels = workload.table(spark, sf, "labels").withColumnRenamed(label, "label").select("doc_id", "label")
    rows = scored.join(labels, "doc_id").collect()
    share, count = accuracy(rows)
    assert count > 500 and share >= least
    assert scored.count() == workload.table(spark, sf, "documents").count()


@pytest.mark.parametrize("train,score", [(toxicity.train_toxicity, toxicity.toxicity_score), (quality.train_quality, quality.quality_score)])
def test_odd_rows(spark, train, score):
    rows = [(t, None if i == 1 else i, "x", 1.0) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "text string, doc_id long, label string, score double")
    for given in ([], [(i, 1, 1) for i in range(9)], [(i, i % 2, i % 2) for i in [*range(9), 2, 2]], [(None, 1, None), (3, None, 0)]):
        labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
        model = train(docs, labels)
        got = docs.withColumn("s", score(model, docs["text"], spark)).collect()
        assert len(got) == len(ODD) and all(0 <= r["s"] <= 1 for r in got)
        by_text = {}
        for r in got:
            by_text.setdefault(r["text"] or "", set()).add(r["s"])
        assert all(len(s) == 1 for s in by_text.values())
    assert docs.limit(0).withColumn("s", score(model, docs["text"], spark)).count() == 0


def test_sample_takes_labels_of_existing_documents_and_long_texts(spark):
    docs = spark.createDataFrame([(i, f"{i} " * 5000, "c") for i in range(1000)], "doc_id long, text string, label string")
    labels = spark.range(100_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    usable = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1000))
    rows, _ = labelled.labelled_sample(docs, labels, "toxic", {0: 1000, 1: 1000}, 400)
    assert len(rows) == usable
    assert all(len(t) == 400 and len(set(t.split()[1:-1])) == 1 and int(t.split()[1]) % 2 == y for t, y in rows)
    with pytest.warns(UserWarning, match="no document with toxic = 1"):
        labelled.labelled_sample(docs, labels.filter("toxic = 0"), "toxic", {0: 5, 1: 5}, 400)


def test_quantile_by_counts(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), rng.exponential(1e6, 20)])
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    ordered = np.sort(values)
    for place in (0, 1, 700, 1999, 2200, 3400, 3519, 9999):
        assert quality.quantile(frame, "v", place) == ordered[min(place, len(values) - 1)]


def test_threshold_covers_all_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = workload.table(spark, sf, "documents"), workload.table(spark, sf, "labels")
    model = quality.train_quality(docs, labels, per_class=20)
    rows = [(r["text"], r["quality"]) for r in docs.join(labels, "doc_id").filter(~labelled.held_out(F.col("doc_id"))).collect() if r["quality"] is not None]
    scores = model.scores([t for t, _ in rows])
    assert abs((scores < model.cut).sum() - sum(y == 0 for _, y in rows)) <= 2


def test_document_scores_against_single_windows(spark):
    """A document scores as its highest window, each computed by itself."""
    sf = "/root/testdata/sf0.01"
    docs, labels = workload.table(spark, sf, "documents"), workload.table(spark, sf, "labels")
    model = toxicity.train_toxicity(docs, labels, positives=60, negatives=60)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()]
    whole = model.scores(texts)
    for text, score in zip(texts, whole):
        words = gru.letter_words(text)
        starts = gru.window_starts(np.array([len(words)]))[1]
        alone = [model.scores([b" ".join(words[s : s + gru.WINDOW]).decode("utf-8", "replace")])[0] for s in starts]
        assert score == pytest.approx(max(alone), abs=1e-3)


def test_held_out_recall_and_precision(spark):
    sf = "/root/testdata/sf0.1"
    scored = workload.QUERIES["op5_toxicity"](spark, sf).filter("held_out")
    rows = scored.join(workload.table(spark, sf, "labels"), "doc_id").filter("toxic is not null").collect()
    hits = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hits >= 0.75 * sum(r["toxic"] for r in rows) and hits >= 0.75 * sum(r["predicted"] for r in rows)


def test_extra_columns_stay(spark):
    docs = spark.createDataFrame([(1, "some text", 5, 6.0, "k")], "doc_id long, text string, __score int, __label double, __key string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels, threshold=1.1)
    assert kept.columns == docs.columns and kept.first()["__score"] == 5
    single = simhash.keep_one(docs.withColumn("__root", F.lit(2)))
    assert single.columns == [*docs.columns, "__root"] and single.first()["__key"] == "k"


def test_sample_is_not_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "c") for i in range(200)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(200)] + [(1, True)], "doc_id long, toxic boolean")
    rows, share = labelled.labelled_sample(docs, labels, "toxic", {0: 20, 1: 1000}, 100)
    ids = [int(t.split()[1]) for t, _ in rows]
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids) and len(set(ids)) == len(ids)
    assert sum(1 for _, y in rows if y == 0) == 20 and 0.3 < share < 0.4
    assert (1 in ids) == any(t == "text 1" and y == 1 for t, y in rows)
