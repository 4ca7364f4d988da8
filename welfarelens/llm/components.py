"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from welfarelens.llm.tables import stored

EDGES = "u long, v long"


def _contract(batches):
    """A task's links as stars: each node with the smallest one its task's links lead to."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    us, vs = [], []
    for x in parent:
        r = find(x)
        if r != x:
            us.append(x)
            vs.append(r)
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger node (``u``) to the smaller one."""
    least = _least(edges)
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 2**20)).first()


def connected_components(links: DataFrame) -> DataFrame:
    """(``u``, ``v``): every node of ``links`` that is not the smallest of its component, and that smallest node.

    ``links`` has two long columns. Every round writes its edges to the shared folder, so a lost executor costs one
    round at most; the number of rounds grows with the logarithm of the longest path. Links from a node to itself
    and with a null are ignored. Nodes are spread by hash; the minimum of a node with very many links is aggregated
    before the shuffle, and the joins that follow can be split by the engine.
    """
    links = links.toDF("u", "v").filter("u != v")
    edges = stored(links.mapInArrow(_contract, EDGES), "links")
    seen = _signature(edges)
    while True:
        edges = stored(_small_star(_large_star(edges)), "links")
        if (now := _signature(edges)) == seen:
            return edges
        seen = now
