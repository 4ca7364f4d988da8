"""SimHash near-duplicates against all pairs."""

import random

import numpy as np
import xxhash

from welfarelens.llm import simhash
from welfarelens.llm.components import connected_components


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in (text or "")).encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, distance=4):
    nodes, root = sorted(set(fps)), {}
    for n in nodes:
        if n in root:
            continue
        stack = [n]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = n
                stack += [y for y in nodes if y not in root and (x ^ y).bit_count() <= distance]
    return [root[f] for f in fps]


def corpus():
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [None, "", " \n ", "one", "ONE", "one two", "É é e", "a b c d", "A  b\tc\x0bd"]
    for _ in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 400))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    texts.append(" ".join(rnd.choice(vocabulary) for _ in range(70_000)))
    return texts


def test_fingerprints_and_components(spark):
    texts = corpus()
    ids = [None, *range(100, 100 + len(texts) - 1)]
    ids[12] = ids[13]
    rows = [(t, i, 7, "x") for t, i in zip(texts, ids)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "text string, doc_id long, fp int, u string").repartition(5)).collect()
    fps = [slow_fingerprint(t) for t in texts]
    roots = slow_components(fps)
    least = {}
    for i, r in zip(ids, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((i is None, i or 0, f, least.get(r)) for i, f, r in zip(ids, fps, roots))
    assert len(set(roots)) < len(set(fps)) < len(texts)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] % 2**64, r["component_id"]) for r in got) == want


def test_links_of_random_and_crowded_fingerprints(spark):
    rnd = random.Random(5)
    fps = []
    for _ in range(300):
        x = rnd.getrandbits(64)
        fps.append(x)
        for _ in range(3):
            y = x
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                y ^= 1 << b
            fps.append(y)
    centre = rnd.getrandbits(64)
    fps += [centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]  # crowds its cells
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3))
    pairs = [(r["u"] % 2**64, r["v"] % 2**64) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    assert len(pairs) < 100_000  # 780 crowded fingerprints make over 300,000 pairs
    roots = {r["u"]: r["v"] for r in connected_components(links).collect()}
    grouped = {}
    for f, s, r in zip(fps, signed, slow_components(fps)):
        grouped.setdefault(r, set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in grouped.values())
    assert len({next(iter(g)) for g in grouped.values()}) == len(grouped)


def test_crowded_cells_match_pairs():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    u, v = simhash.verified(np.zeros(len(fps), np.uint64), fps, 2)
    assert len(u) < len(fps) and (np.bitwise_count(u ^ v) <= 2).all()


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (7, None)]
    got = {r["u"]: r["v"] for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{i: 1000 for i in range(1001, 1400)}}


def test_keep_one(spark):
    rows = [("a b c d e f", 3, "k"), ("A b c d e f", 2, "k"), ("x y z", 9, "k"), (None, 4, "k"), ("", 4, "k"), ("p q", None, "k"), ("p q", None, "k")]
    docs = spark.createDataFrame(rows, "text string, doc_id long, fp string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert got == [(False, 2, "A b c d e f"), (False, 4, ""), (False, 9, "x y z"), (True, 0, "p q")]
    assert simhash.keep_one(docs.limit(0)).count() == 0
