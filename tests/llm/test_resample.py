"""Importance resampling against a plain recount."""

import hashlib
import math
import random
import re
import zlib

import pytest

from welfarelens.llm import resample


def plain(rows, target, buckets=10_000, longest=1, percent=10, least=20, seed=2024):
    def found(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in found(text)[1]:
                counts[bucket(f)] += 1
    S, T = sum(s), sum(t)
    out = []
    for doc, text in rows:
        words, features = found(text)
        total = sum(
            math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, features)
        )
        weight = total // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(features), weight, score, None, len(words) >= least])
    able = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for n, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = n + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def corpus(n=900):
    rnd = random.Random(11)
    words = ["the", "The", "café", "naïve,", "x1-y2", "a_b", "9", "東京", "ÉTÉ", "end."] + [f"w{i}" for i in range(300)]
    texts = [None, "", "...", "one", " \n\t", "THE the the", " ".join(["deep"] * 90_000)]
    while len(texts) < n:
        texts.append(" ".join(rnd.choices(words, k=rnd.randint(1, 120))))
    texts[50:60] = texts[60:70]
    ids = [None, None, *range(5, n + 3)]
    ids[70] = ids[71] = ids[72]
    texts[70] = texts[71] = texts[72]
    return list(zip(ids, texts))


@pytest.mark.parametrize("longest,block,few", [(1, 1 << 18, 1 << 14), (2, 40, 10), (1, 7, 1)])
def test_equals_a_plain_recount(spark, longest, block, few):
    rows, target = corpus(), ["the w1 w2 W3 café", None, "w1 w1 w1", ""]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, falling string")
    held = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.importance_resample(docs.repartition(6), held, longest=longest, block=block, few=few)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint"] * 5
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == plain(rows, target, longest=longest)
    assert sum(r[4] is not None for r in got) > 50


def test_draw_in_ties_and_of_all(spark):
    rows = [(i % 3, "same words again and again") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = resample.importance_resample(docs, docs, percent=50, least_words=5, block=3, few=1).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 16))
    best = sorted({(-r["score"], r["doc_id"]) for r in got})
    assert {r["doc_id"] for r in got if r["rank"] and r["rank"] <= 10} == {best[0][1]}
    every = resample.importance_resample(docs, docs, percent=100, least_words=0, block=4, few=2).collect()
    assert sorted(r["rank"] for r in every) == list(range(1, 31))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    full = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resample.importance_resample(docs, full).collect() == []
    assert [tuple(r) for r in resample.importance_resample(full, docs).collect()] == plain([(1, "a b")], [])
