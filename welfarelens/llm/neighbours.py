"""Approximate nearest neighbours by cosine with balanced posting lists.

Every different vector is filed under the lists of its nearest centroids: one inside a cluster, up to eight near
boundaries. A graph over the centroids, held in memory, is searched for a vector's nearest ones. A query reads the lists
whose centroids are at most a ratio farther than its nearest one. Lists too long for one task are cut by hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from welfarelens.llm.tables import stored
from welfarelens.session import ship_package

#: The centroids, the graph and the pruning ratio are fitted on at most so many vectors, chosen by hash.
SAMPLE = 16_384
#: Different vectors per list aimed at, and lists at most, which bounds what is broadcast.
PER_LIST, MOST_LISTS = 200, 1024
#: A vector is filed under centroids at most so much farther than its nearest, and under so many lists at most.
CLOSURE, COPIES = 1.25, 8
#: Links of a centroid in the graph, and starting points of a search.
DEGREE, ENTRIES = 16, 8
#: Share of the sample's true neighbours that the pruning ratio must reach.
REACHED = 0.97
#: Vectors and queries one task holds together.
TASK_VECTORS, TASK_QUERIES = 8192, 8192
BATCH = 1024
#: Pairs of a query and a vector that are scored at once.
PAIRS = 1 << 16


@dataclass
class Lists:
    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    ratio: float

    def nearest(self, vectors: np.ndarray, wanted: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of the graph for many vectors at once.

        Gives distances to all centroids the search has met (infinite for others) and their order. A search ends when
        the nearest centroid not yet expanded is farther than the ``wanted``-th best and than ``ratio`` times the best.
        """
        n, k = len(vectors), len(self.centroids)
        far = np.full((n, k), np.inf, np.float32)
        far[:, self.entries] = distances(vectors, self.centroids[self.entries])
        todo = far.copy()
        rows = np.arange(n)
        while len(rows):
            at = todo[rows].argmin(axis=1)
            near = todo[rows, at]
            best = np.partition(far[rows], min(wanted, k) - 1, axis=1)[:, min(wanted, k) - 1]
            going = np.isfinite(near) & (near <= np.maximum(best, ratio * far[rows].min(axis=1)))
            rows, at = rows[going], at[going]
            if not len(rows):
                break
            todo[rows, at] = np.inf
            links = self.graph[at]
            new = ~np.isfinite(far[rows[:, None], links])
            r, c = np.repeat(rows, links.shape[1])[new.ravel()], links.ravel()[new.ravel()]
            d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", vectors[r], self.centroids[c]), 1e-24))
            far[r, c] = d
            todo[r, c] = d
        return far, np.argsort(far, axis=1)

    def filed(self, vectors: np.ndarray) -> list[list[int]]:
        """The lists each vector is filed under."""
        far, order = self.nearest(vectors, COPIES, 1.0)
        order = order[:, :COPIES]
        near = np.take_along_axis(far, order, axis=1)
        kept = np.isfinite(near) & (near <= CLOSURE * near[:, :1])
        return [o[k].tolist() for o, k in zip(order, kept)]

    def read(self, vectors: np.ndarray) -> list[list[int]]:
        """The lists each query reads."""
        far, _ = self.nearest(vectors, 1, self.ratio)
        return [np.flatnonzero(f <= self.ratio * f.min()).tolist() for f in far]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of vectors of length one, worked out in double precision for groups of near copies."""
    out = np.empty((len(a), len(b)), np.float32)
    for n in range(0, len(a), BATCH):
        out[n : n + BATCH] = np.sqrt(np.maximum(2 - 2 * (a[n : n + BATCH] @ b.T), 1e-24))
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit_lists(sample: np.ndarray, count: int, rounds: int = 10, seed: int = 0) -> Lists:
    """Balanced centroids of unit vectors, their graph, and the pruning ratio that reaches enough true neighbours."""
    rng = np.random.default_rng(seed)
    count = max(1, min(count, len(sample)))
    centroids = sample[rng.choice(len(sample), count, replace=False)].copy()
    crowd = np.zeros(count, np.float32)
    for _ in range(rounds):
        at = (distances(sample, centroids) + crowd).argmin(axis=1)
        sizes = np.bincount(at, minlength=count)
        crowd += 0.05 * (sizes * count / len(sample) - 1).clip(-1, 1).astype(np.float32)  # full lists seem farther
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, sample)
        lost = (sizes == 0) | (np.linalg.norm(sums, axis=1) < 1e-6)
        sums[lost] = sample[rng.choice(len(sample), int(lost.sum()))]
        centroids = unit(sums)
    between = distances(centroids, centroids)
    graph = np.argsort(between, axis=1, kind="stable")[:, 1 : DEGREE + 1]
    if count > 1:  # a ring beside the nearest links keeps the graph connected
        graph = np.concatenate([graph, np.roll(np.arange(count), -1)[:, None]], axis=1)
    else:
        graph = np.zeros((1, 1), np.int64)
    lists = Lists(centroids, graph, np.linspace(0, count - 1, min(ENTRIES, count)).astype(np.int64), 1.0)
    queries = sample[:512]
    alike = queries @ sample.T
    alike[np.arange(len(queries)), np.arange(len(queries))] = -2
    best = np.argsort(-alike, axis=1)[:, : min(5, len(sample) - 1)]
    if best.size:
        to = distances(queries, centroids)
        filed = lists.filed(sample[best.ravel()])
        asked = np.repeat(np.arange(len(queries)), best.shape[1])
        needed = [to[q, f].min() / to[q].min() for q, f in zip(asked, filed)]
        lists.ratio = float(max(1.0, np.quantile(needed, REACHED))) + 1e-4
    return lists


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector`` of the rows that take part, one per id (of several, the least vector).

    Single precision stays as it is; any other numbers are taken in double precision.
    """
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    kind = "float" if single else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast(kind)))
    rows = rows.filter("vec_id IS NOT NULL AND vector IS NOT NULL").filter(finite & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def different_vectors(valid: DataFrame, least_ids: int) -> DataFrame:
    """``item`` (smallest id), ``ids`` (the ``least_ids`` smallest) and ``vector`` of every different vector.

    The engine keeps the smallest ids of a vector in each task before the shuffle, however often a vector repeats.
    """
    number = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    first = valid.withColumn("number", number).filter(F.col("number") <= least_ids)
    ids = first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return ids.select(F.col("ids")[0].alias("item"), "ids", "vector")


def matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of ``a`` and ``b`` in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    dot = (a * b).sum(axis=1)
    return dot / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def least_names(v: np.ndarray, names: np.ndarray, wanted: int) -> np.ndarray:
    """Places of the ``wanted`` smallest names of each direction: positive multiples of a vector have equal cosines."""
    direction = v.astype(np.float64)
    direction /= np.abs(direction).max(axis=1, keepdims=True)
    same = np.unique(direction + 0.0, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((names, same))
    number = np.arange(len(order)) - np.searchsorted(same[order], same[order])
    return np.sort(order[number < wanted])


def best_of(q: np.ndarray, v: np.ndarray, names: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the ``wanted`` vectors with the greatest exact cosine of each query, by score and name.

    A product of unit vectors finds whatever can be among them: its error is far below the slack, so all that is within
    the slack of the last place is scored exactly, in parts of bounded size.
    """
    kept = least_names(v, names, wanted)
    v, names = v[kept], names[kept]
    uv, uq = unit(v), unit(q)
    take = min(wanted, len(v))
    slack = 8 * (v.shape[1] + 8) * np.finfo(np.float64).eps
    out: list[tuple] = []
    for a in range(0, len(q), BATCH // 2):
        alike = uq[a : a + BATCH // 2] @ uv.T
        last = np.partition(alike, len(v) - take, axis=1)[:, len(v) - take]
        near = alike >= last[:, None] - slack
        ends = np.cumsum(near.sum(axis=1))
        lo = 0
        while lo < len(near):
            begin = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, begin + PAIRS, "right")))
            who, at = np.nonzero(near[lo:hi])
            score = exact(q[a + lo + who], v[at])
            order = np.lexsort((names[at], -score, who))
            number = np.arange(len(order)) - np.searchsorted(who, who[order])
            first = order[number < wanted]
            out.append((a + lo + who[first], kept[at[first]], score[first]))
            lo = hi
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest_neighbours(vectors: DataFrame, is_query, nearest: int = 5) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the nearest rows found for each row that ``is_query`` selects.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on ``vec_id``. Scores are exact cosines
    of the original vectors; equal scores are ordered by id. Rows with a null id, a null, zero, non-finite or partly
    null vector take no part, nor do vectors of another length than the most frequent one. An id that repeats counts
    once. Queries find all other rows if these are fewer than ``nearest``. Equal vectors are searched once and their
    smallest ids are given. Other columns are ignored; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    valid = valid_vectors(vectors)
    valid = stored(valid.withColumn("dims", F.size("vector")), "vectors")
    dims = valid.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if dims is None:
        return spark.createDataFrame([], schema)
    valid = valid.filter(F.col("dims") == dims["dims"]).drop("dims")
    items = stored(different_vectors(valid, nearest + 1), "items")
    total = items.count()
    rows = items.orderBy(F.xxhash64("item"), "item").limit(SAMPLE).select("vector").collect()
    fitted = fit_lists(unit(np.array([r[0] for r in rows], np.float64)), min(MOST_LISTS, total // PER_LIST))
    shared = spark.sparkContext.broadcast(fitted)
    kind = items.schema["vector"].dataType.simpleString()

    queries = valid.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector")
    asked = queries.join(items.select("item", "vector"), "vector").select("query_id", "item")
    asked = stored(asked, "queries")
    asked_items = asked.select("item").distinct().withColumn("asked", F.lit(True))

    def file(batches):
        index = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                v = unit(matrix(part.column("vector")))
                ask = np.array(part.column("asked").to_pylist(), bool)
                read: list[list[int]] = [[] for _ in ask]
                for i, lists in zip(np.flatnonzero(ask), index.read(v[ask]) if ask.any() else []):
                    read[i] = lists
                lists = pa.array(index.filed(v), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("item"), part.column("vector"), lists, pa.array(read, pa.list_(pa.int32()))],
                    names=["item", "vector", "filed", "read"],
                )

    flagged = items.select("item", "vector").join(asked_items, "item", "left").select("item", "vector", F.coalesce("asked", F.lit(False)).alias("asked"))
    index = stored(flagged.mapInArrow(file, f"item long, vector {kind}, filed array<int>, read array<int>"), "index")

    def sizes(column: str, most: int, name: str) -> DataFrame:
        counts = index.select(F.explode(column).alias("list")).groupBy("list").count()
        return counts.select("list", F.ceil(F.col("count") / most).cast("int").alias(name))

    cuts = F.broadcast(sizes("filed", TASK_VECTORS, "v_cuts").join(sizes("read", TASK_QUERIES, "q_cuts"), "list"))

    def dealt(column: str, own: str, other: str) -> DataFrame:
        rows = index.select("item", "vector", F.explode(column).alias("list")).join(cuts, "list")
        part = F.pmod(F.xxhash64("item"), F.col(own)).cast("int")
        rows = rows.withColumn(own, part).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        # new names: both sides of the cogroup come from the same table
        return rows.select("list", "v_cuts", "q_cuts", F.col("item").alias(own + "_item"), F.col("vector").alias(own + "_vector"))

    def search(lists: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if lists.num_rows and asking.num_rows:
            v, q = matrix(lists["v_cuts_vector"]), matrix(asking["q_cuts_vector"])
            names, askers = lists["v_cuts_item"].to_numpy(), asking["q_cuts_item"].to_numpy()
            who, at, score = best_of(q, v, names, nearest + 1)
            out.append((askers[who], names[at], score))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["asker", "found", "score"])

    keys = ["list", "v_cuts", "q_cuts"]
    met = dealt("filed", "v_cuts", "q_cuts").groupBy(*keys).cogroup(dealt("read", "q_cuts", "v_cuts").groupBy(*keys)).applyInArrow(search, "asker long, found long, score double")
    met = met.groupBy("asker", "found").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "found"))
    best = met.withColumn("place", place).filter(F.col("place") <= nearest + 1).drop("place")
    named = best.join(items.select(F.col("item").alias("found"), "ids"), "found").select("asker", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.join(named, asked["item"] == named["asker"]).filter("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
