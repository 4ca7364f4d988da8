"""Benchmark overlaps against a search of all diagonals."""

import random

import numpy as np

from welfarelens.llm import decontamination as d
from welfarelens.llm import workload


def like(equal):
    """Whether any stretch has ten equal words, 80 % of its words."""
    sums = np.concatenate([[0], np.cumsum(equal)])
    same = sums[None, :] - sums[:, None]
    width = np.arange(len(sums))[None, :] - np.arange(len(sums))[:, None]
    return bool(((same >= 10) & (5 * same >= 4 * width)).any())


def hit(equal):
    """Whether a mask fits somewhere, which takes two texts to the same seed."""
    return any(all(equal[at + p] for p in mask) for mask in d.MASKS for at in range(len(equal) - mask[-1]))


def slow(text, item):
    """Whether any diagonal with a common seed has an overlap."""
    a, b = d.words(text), d.words(item)
    for shift in range(-len(b), len(a)):
        lo, hi = max(0, -shift), min(len(b), len(a) - shift)
        if hi - lo >= 10:
            equal = np.array([a[shift + i] == b[i] for i in range(lo, hi)])
            if equal.sum() >= 10 and hit(equal) and like(equal):
                return True
    return False


def test_against_all_diagonals(spark):
    rnd = random.Random(2)
    vocabulary = [f"v{i}" for i in range(300)]
    draw = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(draw(rnd.randint(8, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, "too short"), (3, "same id " + " ".join(draw(20)))]
    docs = []
    for n in range(160):
        body = draw(rnd.randint(0, 120))
        if n % 2:
            passage = rnd.choice(items)[1] or ""
            passage = passage.split()
            if n % 4 == 1 and passage:
                passage = passage[: rnd.randint(5, len(passage)) if len(passage) > 5 else None]
            for _ in range(int(len(passage) * rnd.choice([0, 0.1, 0.2, 0.35]))):
                passage[rnd.randrange(len(passage))] = "sub"
            at = rnd.randint(0, len(body))
            body[at:at] = passage
        docs.append((rnd.choice([", ", " ", "\n"]).join(body).upper() if n % 3 else " ".join(body), n, "x", "y"))
    docs += [(None, 500, "x", "y"), ("", None, "x", "y"), (items[0][1], None, "x", "y"), (items[0][1] * 1, 501, "x", "y"), ("w " * 200_000 + items[1][1], 502, "x", "y")]
    frame = spark.createDataFrame(docs, "text string, doc_id long, item_id string, length string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.find_overlaps(frame, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    want = {(i, k) for t, i, *_ in docs if i != 502 for k, item in items if slow(t, item)} | {(502, 1)}
    assert found == want
    assert len(found) > 40 and (None, 0) in found and (501, 0) in found and (502, 1) in found
    for r in got:
        assert r["matched"] >= 10 and r["matched"] >= 0.8 * r["length"]
    kept = d.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    bad = {i for i, _ in found}
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted((i or -1) for t, i, *_ in docs if i not in bad or (i is None and not t))
    assert d.find_overlaps(frame.limit(0), bench).count() == 0
    assert d.find_overlaps(frame, bench.limit(0)).count() == 0 and d.drop_contaminated(frame, bench.limit(0)).count() == len(docs)


def test_blocks_give_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    docs, bench = workload.table(spark, sf, "documents"), workload.table(spark, sf, "benchmark")
    one = sorted(map(tuple, d.find_overlaps(docs, bench).collect()), key=str)
    monkeypatch.setattr(d, "BLOCK_BYTES", 3000)
    assert sorted(map(tuple, d.find_overlaps(docs, bench).collect()), key=str) == one and one


def test_overlap_against_all_stretches():
    rng = np.random.default_rng(4)
    for n in range(400):
        equal = rng.random(int(rng.integers(1, 90))) < rng.choice([0.5, 0.7, 0.8, 0.9])
        got = d.overlap(equal)
        assert (got is not None) == like(equal), n
        if got:
            start, same, size = got
            assert equal[start : start + size].sum() == same >= 10 and 5 * same >= 4 * size
    runs = lambda *parts: np.concatenate([np.full(abs(p), p > 0) for p in parts])
    spread = np.array([i % 7 != 6 for i in range(20)])
    assert d.overlap(np.concatenate([runs(9, -30), spread]))[1:] == (18, 20)
    assert d.overlap(np.concatenate([spread, runs(-30, 9)]))[0] == 0
    assert d.overlap(runs(9, -2, 1)) == (0, 10, 12)


def test_a_longer_run_before_the_overlap(spark):
    words = [f"a{i}" for i in range(60)]
    text = words[:9] + [f"b{i}" for i in range(30)] + [w if i % 7 != 6 else "x" for i, w in enumerate(words[39:59])]
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert [(r["item_id"], r["matched"]) for r in d.find_overlaps(docs, bench).collect()] == [(7, 18)]
    assert d.drop_contaminated(docs, bench).count() == 0


def test_substitutions_at_the_limit():
    equal = np.array([i % 5 != 4 for i in range(25)])
    assert d.overlap(equal)[1] == 20
    assert d.overlap(np.array([True] * 9)) is None and d.overlap(np.array([True] * 10)) == (0, 10, 10)
    assert d.overlap(np.array([i % 2 == 0 for i in range(60)])) is None
