"""Shards of nearly equal bytes for indivisible groups, by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

from welfarelens.llm.tables import stored

#: Groups below the heavy size are dealt to so many bundles by hash; a bundle moves as one.
BUNDLES = 4096
#: A group is heavy if it has at least this part of an even shard's bytes, so there are at most PART x shards of them.
PART = 256
#: Rows numbered by one task.
NUMBERED_ROWS = 20_000


def differencing(sizes: list[int], shards: int) -> list[int]:
    """A shard for each size, sums nearly equal.

    Every size starts as a partial partition with one filled part. The two partial partitions with the largest spread
    are combined, the largest part of one with the smallest of the other, until one is left.
    """
    heap = [(-s, i, [0] * (shards - 1) + [s], [None] * (shards - 1) + [(i,)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, sums, members = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        parts = [(sums[k] + more[-1 - k], (members[k], others[-1 - k])) for k in range(shards)]
        parts.sort(key=lambda p: p[0])
        least = parts[0][0]
        made += 1
        new = [p[0] - least for p in parts]
        heapq.heappush(heap, (-new[-1], made, new, [p[1] for p in parts]))
    out = [0] * len(sizes)
    for shard, tree in enumerate(heap[0][3] if heap else []):
        stack = [tree]
        while stack:
            node = stack.pop()
            if node is None:
                continue
            if len(node) == 1:
                out[node[0]] = shard
            else:
                stack += node
    return out


def group_key(text: Column) -> Column:
    """Equal texts have equal keys; a null text goes with the empty ones. Texts that collide only share a shard."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


class ShardMap:
    """The shard of every group: heavy groups by key, all others by the bundle of their key.

    Both tables are bounded whatever the input: ``BUNDLES`` rows and ``PART`` times the shards.
    """

    def __init__(self, groups: DataFrame, shards: int):
        """``groups``: ``key`` and ``bytes`` of each group."""
        self.spark = groups.sparkSession
        total = groups.agg(F.sum("bytes")).first()[0] or 0
        heavy = F.col("bytes") * F.lit(shards * PART).cast("decimal(38,0)") >= F.lit(total).cast("decimal(38,0)")
        items = [(r["key"], None, r["bytes"]) for r in groups.filter(heavy).orderBy("key").collect()]
        light = groups.filter(~heavy).groupBy(self.bundle(F.col("key")).alias("bundle")).agg(F.sum("bytes").alias("bytes"))
        items += [(None, r["bundle"], r["bytes"]) for r in light.orderBy("bundle").collect()]
        chosen = differencing([b for _, _, b in items], shards)
        self.heavy = [(k, s) for (k, _, _), s in zip(items, chosen) if k is not None]
        self.light = [(b, s) for (_, b, _), s in zip(items, chosen) if b is not None]

    @staticmethod
    def bundle(key: Column) -> Column:
        return F.pmod(F.shiftright(key, 16), F.lit(BUNDLES)).cast("int")

    def assign(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` with ``shard``; nothing is shuffled."""
        heavy = self.spark.createDataFrame(self.heavy, f"{key} long, __heavy int")
        light = self.spark.createDataFrame(self.light, "__bundle int, __light int")
        rows = rows.withColumn("__bundle", self.bundle(F.col(key)))
        rows = rows.join(F.broadcast(heavy), key, "left").join(F.broadcast(light), "__bundle", "left")
        return rows.withColumn("shard", F.coalesce("__heavy", "__light")).drop("__bundle", "__heavy", "__light")


def shard_by_bytes(docs: DataFrame, shards: int) -> DataFrame:
    """Every row's ``doc_id``, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``shard`` and ``slot``.

    Equal texts share a shard; shards have nearly equal bytes as far as the largest group allows. ``slot`` counts a
    shard's rows from 0 without gaps. A null text has 8 bytes and goes with the empty ones; rows with null or repeated
    ids, and rows equal in all, have a slot each. Other columns are ignored; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), group_key(text).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sized",
    )
    shard_map = ShardMap(sized.groupBy("key").agg(F.sum("size").alias("bytes")), shards)
    blocks = max(1, sized.count() // (shards * NUMBERED_ROWS))
    placed = shard_map.assign(sized, "key").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return _numbered(placed).select("doc_id", "size", "text_crc32", "shard", "slot")


def _numbered(placed: DataFrame) -> DataFrame:
    """``slot`` from prefix sums over blocks of a shard and the row's number in its block."""
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("block")) - F.col("rows")
    bases = counts.select("shard", "block", before.alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row")) - 1
    return placed.withColumn("number", number).join(bases, ["shard", "block"]).withColumn("slot", F.col("base") + F.col("number"))


def write_shards(docs: DataFrame, folder: str, shards: int) -> None:
    """``docs`` as Parquet with one sub-folder per shard, all columns. Nothing is shuffled; ``shard`` must not be a column."""
    keyed = docs.withColumn("__key", group_key(F.col("text").cast("string")))
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long") + 8
    shard_map = ShardMap(keyed.groupBy("__key").agg(F.sum(size).alias("bytes")).withColumnRenamed("__key", "key"), shards)
    shard_map.assign(keyed, "__key").drop("__key").write.partitionBy("shard").parquet(folder)
