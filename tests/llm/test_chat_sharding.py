"""Chat formatting against SQL and by hand; sharding by its laws."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from welfarelens.llm import chat, sharding, workload
from workloads import check


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_chat_equals_sql(spark, sf):
    ok, text = check.compare(spark, check.duck(sf), sf, workload.QUERIES["op3_chat_format"], workload.SQL["op3_chat_format"])
    assert ok, text


def turns(conv, *lines):
    return [(conv, i, "user" if i % 2 == 0 else "assistant", t, "x") for i, t in enumerate(lines)]


def test_chat_by_hand(spark):
    rows = turns(1, "a", "b") + turns(2, "a", "b", "c") + turns(3, "a", "b", "c") + turns(4, "a") + turns(5, "b", "a")
    rows += [(None, 0, "user", "lost", "x"), (6, None, None, None, "x"), (6, 3, " USER ", "<|im_end|>", "x"), (6, 3, "user", "<|im_end|>", "x")]
    rows += turns(7, *[f"t{i}" for i in range(700)]) + turns(8, *[f"t{i}" for i in range(699)])
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(5)
    got = {(r["conv_id"], r["part"]): r["text"] for r in chat.format_chats(docs).collect()}
    assert sorted((c or -1, p) for c, p in got) == [(-1, 0), (2, 0), (5, 0), (6, 0), (7, 0), (7, 1), (7, 2)]
    assert got[2, 0] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in (("user", "a"), ("assistant", "b"), ("user", "c")))
    assert got[6, 0] == "<|im_start|>unknown\n<|im_end|>\n" + 2 * "<|im_start|>user\n< |im_end|><|im_end|>\n"
    assert "".join(got[7, p] for p in range(3)).count("<|im_start|>") == 700
    assert chat.format_chats(docs.limit(0)).count() == 0


def test_hashes_cannot_overflow(spark):
    """A rolling hash over very many turns of one block stays within a long, whatever the turns are."""
    turns = spark.range(1 << 20).select(
        F.lit(1).cast("long").alias("key"), F.lit(0).cast("long").alias("block"), F.col("id").alias("pos"), F.lit("user").alias("role"),
        F.lit("").alias("body"), (F.col("id") == (1 << 20) - 1).alias("last"),
    )
    last = chat.prefix_hashes(turns).filter("last").first()
    assert last["length"] == 1 << 20 and last["a"] != last["b"]
    rows = spark.range(40_000).select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    parts = chat.format_chats(rows).collect()
    assert sum(r["turns"] for r in parts) == 40_000 and max(r["turns"] for r in parts) == chat.BLOCK


def test_turn_numbers_do_not_matter(spark):
    rows = [(1, 5, "user", "a"), (1, 900, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [r["conv_id"] for r in got] == [2]


def test_differencing():
    rnd = random.Random(1)
    for _ in range(50):
        sizes = [rnd.randint(1, 60) for _ in range(rnd.randint(1, 9))]
        sums = [0, 0]
        for s, k in zip(sizes, sharding.differencing(sizes, 2)):
            sums[k] += s
        left = sorted(sizes)  # for two parts, the two largest differences are replaced by their difference
        while len(left) > 1:
            left = sorted([*left[:-2], left[-1] - left[-2]])
        assert abs(sums[0] - sums[1]) == left[0]
    sizes = [rnd.randint(100, 10_000) for _ in range(3000)]
    sums = [0] * 24
    for s, k in zip(sizes, sharding.differencing(sizes, 24)):
        sums[k] += s
    assert max(sums) - min(sums) <= 20
    assert sharding.differencing([], 3) == [] and sharding.differencing([5], 3) in ([0], [1], [2])


def held(rows, shards=24):
    by_shard, by_text = {}, {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
    assert set(by_shard) <= set(range(shards))
    for group in by_shard.values():
        assert sorted(r["slot"] for r in group) == list(range(len(group)))
    return [sum(r["size"] for r in by_shard.get(k, [])) for k in range(shards)]


def test_sharding_laws(spark):
    sf = "/root/testdata/sf0.1"
    rows = workload.QUERIES["op7_sharding"](spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in workload.table(spark, sf, "documents").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    shard_of = {}
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"], r["law"]) == (len(data) + 8, zlib.crc32(data), None, "bytes")
        assert shard_of.setdefault(data, r["shard"]) == r["shard"]
    sums = held(rows)
    assert max(sums) - min(sums) < 0.001 * sum(sums) / 24


def test_sharding_odd_rows(spark, tmp_path):
    rows = [("hot " * 50, i, "x") for i in range(300)] + [(None, None, "x"), ("", None, "x"), (None, None, "x"), ("long " * 40_000, 7, "x")]
    rows += [(f"text {i}", i, "x") for i in range(500)] + [("same", 1, "x")] * 9
    docs = spark.createDataFrame(rows, "text string, doc_id long, shard string").repartition(6)
    got = sharding.shard_by_bytes(docs, 5).collect()
    held(got, 5)
    assert len(got) == len(rows) and len({r["shard"] for r in got if r["size"] == 208}) == 1
    assert sharding.shard_by_bytes(docs.limit(0), 5).count() == 0
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.filter("text = 'same'").select("shard").distinct().count() == 1
