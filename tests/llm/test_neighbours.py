"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from welfarelens.llm import neighbours, workload


def slow(rows, nearest=5, every=50):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = min(good.get(i, list(v)), list(v))
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids], np.float64)
    out = {}
    for q in ids[ids % every == 0]:
        a = np.array(good[q], np.float64)
        score = (x * a).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (a * a).sum())
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:nearest]
        out[int(q)] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("sf,least", [("/root/testdata/sf0.01", 0.95), ("/root/testdata/sf0.1", 0.9)])
def test_recall_on_the_table(spark, sf, least):
    got = found(workload.QUERIES["op8_neighbours"](spark, sf).collect())
    want = slow([tuple(r) for r in workload.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()])
    assert set(got) == set(want) and recall(got, want) >= least
    scores = {(q, i): s for q, w in want.items() for i, s in w}
    assert all(len(got[q]) == len(want[q]) for q in want)
    assert all(abs(s - scores[q, i]) < 1e-12 for q, g in got.items() for i, s in g if (q, i) in scores)


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(4).astype(np.float32).tolist(), "a") for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0], "a") for i in range(400)]  # equal vectors
    rows += [(50, None, "a"), (2000, [0.0] * 4, "a"), (2050, [1.0, None, 0.0, 0.0], "a"), (2100, [float("nan")] * 4, "a")]
    rows += [(2150, [float("inf"), 0.0, 0.0, 0.0], "a"), (None, [1.0] * 4, "a"), (2200, [], "a"), (2250, [1.0, 2.0], "a"), (100, rows[100][1], "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, item string").repartition(4)
    got = found(neighbours.nearest_neighbours(frame, F.col("vec_id") % 50 == 0).collect())
    want = slow([(i, v) for i, v, _ in rows if v is None or len(v) == 4])
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
    few = neighbours.nearest_neighbours(frame.filter("vec_id IN (0, 1, 50, 3)"), F.col("vec_id") % 50 == 0)
    assert {q: len(g) for q, g in found(few.collect()).items()} == {0: 3, 50: 3}
    assert neighbours.nearest_neighbours(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_cut_lists_give_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    one = found(workload.QUERIES["op8_neighbours"](spark, sf).collect())
    monkeypatch.setattr(neighbours, "TASK_VECTORS", 60)
    monkeypatch.setattr(neighbours, "TASK_QUERIES", 4)
    assert found(workload.QUERIES["op8_neighbours"](spark, sf).collect()) == one


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(1)
    sample = neighbours.unit(rng.standard_normal((3000, 16)))
    lists = neighbours.fit_lists(sample, 60)
    far, order = lists.nearest(sample[:200], 8, 1.0)
    true = neighbours.distances(sample[:200], lists.centroids)
    assert (order[:, 0] == true.argmin(axis=1)).mean() > 0.97
    sizes = np.bincount(true.argmin(axis=1), minlength=60)
    assert lists.ratio >= 1 and sizes.max() < 40


@pytest.mark.parametrize("noise", [1e-3, 3e-5])
def test_near_copies(spark, noise):
    rng = np.random.default_rng(2)
    one = rng.standard_normal(64)
    rows = [(i, (one + noise * rng.standard_normal(64)).astype(np.float32).tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = found(neighbours.nearest_neighbours(frame, F.col("vec_id") % 50 == 0).collect())
    assert recall(got, slow(rows)) >= 0.9


def test_best_of_near_and_scaled_copies():
    rng = np.random.default_rng(3)
    one = rng.standard_normal(64)
    near = (one + 1e-4 * rng.standard_normal((3000, 64))).astype(np.float32)
    who, at, score = neighbours.best_of(near[:20], near, np.arange(3000), 6)
    for i in range(20):
        every = neighbours.exact(np.repeat(near[i : i + 1], 3000, axis=0), near)
        assert at[who == i].tolist() == np.lexsort((np.arange(3000), -every))[:6].tolist()
    scaled = (np.arange(1, 3001)[:, None] * np.arange(1, 9)[None]).astype(np.float32)
    names = rng.permutation(3000)
    who, at, score = neighbours.best_of(scaled[:20], scaled, names, 6)
    assert all(names[at[who == i]].tolist() == list(range(6)) for i in range(20))


def test_vectors_of_doubles_keep_their_precision(spark):
    rng = np.random.default_rng(9)
    for size in (1e39, 1e-60, 1.0):
        rows = [(i, (size * (rng.standard_normal(6) * 1e-9 + 1)).tolist()) for i in range(60)]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        got = found(neighbours.nearest_neighbours(frame, F.col("vec_id") % 50 == 0).collect())
        want = slow([(i, (np.array(v) / size).tolist()) for i, v in rows])
        assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()} or size == 1.0 or all(
            abs(a - b) < 1e-15 for q in want for (_, a), (_, b) in zip(got[q], want[q])
        )
        assert all(len(g) == 5 for g in got.values()) and set(got) == {0, 50}
