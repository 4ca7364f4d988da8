"""Components of similar shingle sets against all pairs."""

import random

import numpy as np
import pytest

from welfarelens.llm import jaccard


def plain(rows, percent=90):
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        sets.append(frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for n, s in enumerate(sets):
        if s and first.setdefault(s, n) != n:
            root[find(n)] = find(first[s])
    distinct = sorted(first.items(), key=lambda x: len(x[0]))
    for i, (a, x) in enumerate(distinct):
        for b, y in distinct[i + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                root[find(x)] = find(y)
    least = {}
    for n, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(n)] = min(doc, least.get(find(n), doc))
    return sorted(((doc, len(sets[n]), least.get(find(n))) for n, (doc, _) in enumerate(rows)), key=str)


def near(rnd, words, vocabulary, changes):
    words = list(words)
    for _ in range(changes):
        at, kind = rnd.randrange(len(words)), rnd.randrange(3)
        if kind == 0:
            words[at] = rnd.choice(vocabulary)
        elif kind == 1:
            words.insert(at, rnd.choice(vocabulary))
        elif len(words) > 2:
            del words[at]
    return words


def corpus(seed, bases=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "é", "The", "the"]
    texts = [None, "", " \n\t ", "one", "ONE", "one two", "one  two", "a b c", "A\x0bB\x0cc", "a b c d", "x\x1cy z", "x y z"]
    line = rnd.choices(vocabulary, k=11)
    for n in range(bases):
        base = rnd.choices(vocabulary, k=rnd.choice([9, 10, 11, 12, 14, 20, 21, 22, 30, 60, 120, 300]))
        base += line if n % 3 == 0 else []
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 5)):
            texts.append(" ".join(near(rnd, base, vocabulary, rnd.choice([0, 1, 1, 1, 2, 3, 4]) * max(1, len(base) // 100))))
    ids = [None, None, *range(10, len(texts) + 8)]
    rnd.shuffle(ids)
    ids[40] = ids[41]
    return list(zip(ids, texts))


def run(spark, rows, parts=5):
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, n int, k1 string").repartition(parts)
    return sorted((tuple(r) for r in jaccard.jaccard_components(docs).collect()), key=str)


def test_equals_all_pairs(spark):
    rows = corpus(1)
    got = run(spark, rows)
    assert got == plain(rows)
    assert len({r[2] for r in got}) < len(got) - 50


@pytest.mark.parametrize("together,block", [(32, 256), (3, 20)])
def test_a_crowd_of_near_copies(spark, monkeypatch, together, block):
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rnd.choices(vocabulary, k=150)
    texts = [" ".join(near(rnd, base, vocabulary, rnd.randint(1, 6))) for _ in range(700)]
    texts += [" ".join(base)] * 20 + [" ".join(rnd.choices(vocabulary, k=150)) for _ in range(50)]
    texts.append(" ".join(rnd.choices(vocabulary, k=50_000)))
    texts.append(" ".join(near(rnd, texts[-1].split(), vocabulary, 700)))
    rows = list(enumerate(texts))
    got = run(spark, rows)
    want = plain(rows)
    assert got == want
    assert 60 < len({r[2] for r in want}) < 700


def test_empty_and_tiny_tables(spark):
    assert run(spark, [(1, "a b c d e f g h i j")]) == [(1, 8, 1)]
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(docs).collect() == []


@pytest.mark.parametrize("size", [9, 10, 13, 14, 20, 21, 60, 300])
def test_every_pair_at_the_threshold_meets(size):
    """Pairs that differ as much as they may share a key, whatever the costs are."""
    rng = np.random.default_rng(size)
    bands, met = jaccard.Bands(90), 0
    for _ in range(150):
        larger = int(rng.integers(size, size * 100 // 90 + 1))
        shared = -(-90 * (size + larger) // 190)
        if shared > size:
            continue
        core = rng.integers(0, 2**64, shared, dtype=np.uint64)
        sets = [np.unique(np.concatenate([core, rng.integers(0, 2**64, n - shared, dtype=np.uint64)])) for n in (size, larger)]
        cells = rng.integers(0, 1000, jaccard.CELLS)
        keyed = [jaccard.set_keys(s, bands, cells, 2000) for s in sets]
        found = False
        for key in np.intersect1d(keyed[0][0], keyed[1][0]):
            a, b = (flags[keys == key] for keys, flags in keyed)
            found |= any(jaccard._meets(x, y) for x in a for y in b)
            if size == larger:
                found |= any(jaccard._meets(y, x) for x in a for y in b)
        assert found
        met += 1
    assert met > 20


def test_words_are_told_apart(monkeypatch):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abAB\u00e9", k=rnd.randint(1, 6))).encode() for _ in range(300)] + [b"x" * 5000, b"x" * 5001, b"y" * 9000]
    text = b"".join(rnd.choice(words) + rnd.choice([b" ", b"\n", b"\t\x0b", b"  "]) for _ in range(2000))
    want = text.lower().split()
    for part in (1 << 20, 1, 50):
        monkeypatch.setattr(jaccard, "PART", part)
        got = jaccard.word_hashes(text)
        assert len(got) == len(want)
        assert len(dict(zip(want, got.tolist()))) == len(set(got.tolist())) == len(set(zip(want, got.tolist())))
