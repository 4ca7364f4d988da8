"""Importance resampling of documents towards a target distribution of hashed word features.

Two passes read the texts: one adds up how often every bucket of features occurs in the documents and in the target
texts, the other scores each document by the gains of its features, looked up in an array with one entry a bucket. The
places of the draw are then found without sorting the table: every block of rows names the median of its keys that may
still be the last drawn one, the medians are weighted by the rows they stand for, and the rows on one side of the
weighted median, at least a quarter, are settled. Only the drawn rows are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from welfarelens.llm.kept import KEPT_WORDS, at_work
from welfarelens.llm.tables import stored
from welfarelens.llm.token_files import text_batches
from welfarelens.session import ship_package, shuffle_width

#: Rows that name one median together.
BLOCK = 1 << 18
#: Keys that may still be the last drawn one are compared by the driver when they are no more than this.
FEW = 1 << 14
NO_ID = 2**63 - 1

KEY = ["falling", "id", "tie", "row"]
SCORED = "doc_id long, n_features long, weight long, score long, enough boolean, tie long"

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII in a UTF-8 text, A-Z in lower case."""
    return (text or b"").translate(_WORDS).split()


def runs(found: list[bytes], longest: int):
    """All runs of 2 to ``longest`` consecutive words, joined by one space."""
    for n in range(2, longest + 1):
        for at in range(len(found) - n + 1):
            yield b" ".join(found[at : at + n])


class _Looked(dict):
    """A value by word, from the word's bucket."""

    def __init__(self, values, buckets: int):
        super().__init__()
        self.values_of, self.buckets = values, buckets

    def __missing__(self, word: bytes) -> int:
        value = self.values_of[zlib.crc32(word) % self.buckets]
        self[word] = value
        return value


def _texts(table: DataFrame, key: Column) -> DataFrame:
    return table.select(key.cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text"))


def bucket_counts(table: DataFrame, buckets: int, longest: int) -> dict[int, int]:
    """Features of all texts by bucket. At most one row a bucket reaches the driver."""
    ship_package(table.sparkSession)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        known = _Looked(range(buckets), buckets)
        for _, texts in text_batches(batches):
            if len(known) > KEPT_WORDS:
                known.clear()
            for text in texts:
                found = words(text)
                if found:
                    total += np.bincount(np.fromiter(map(known.__getitem__, found), np.int64, len(found)), minlength=buckets)
                for run in runs(found, longest):
                    total[zlib.crc32(run) % buckets] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    counted = _texts(table, F.lit(None)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in counted.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Floored thousandths of the log ratio of every bucket's smoothed share in the target and in the source."""
    s, t = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s / ((source.get(b, 0) + 1.0) * t))) for b in range(buckets)]


def noise(doc_id: int | None, seed: int) -> int:
    """Floored thousandths of a standard Gumbel variate that depends on the id only."""
    named = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    h = int(hashlib.sha256(named).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: list[int], longest: int, least_words: int, seed: int) -> DataFrame:
    ship_package(docs.sparkSession)
    buckets = len(gain)
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches):
        gain = shared.value
        known = _Looked(gain, buckets)
        at_work("gains", known.clear)
        for ids, texts in text_batches(batches):
            if len(known) > KEPT_WORDS:
                known.clear()
            rows = []
            for doc_id, text in zip(ids, texts):
                found = words(text)
                n, total = len(found), sum(map(known.__getitem__, found))
                for run in runs(found, longest):
                    n, total = n + 1, total + gain[zlib.crc32(run) % buckets]
                weight = total // n if n else 0
                tie = xxhash.xxh64_intdigest(text or b"") - 2**63
                rows.append((doc_id, n, weight, weight + noise(doc_id, seed), len(found) >= least_words, tie))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.bool_()), pa.array(columns[5], pa.int64())],
                    names=["doc_id", "n_features", "weight", "score", "enough", "tie"],
                )

    return _texts(docs, F.col("doc_id")).mapInArrow(score, SCORED)


def _key() -> Column:
    return F.struct(*KEY)


def _fixed(key: tuple) -> Column:
    return F.struct(*(F.lit(int(k)).cast("long").alias(c) for c, k in zip(KEY, key)))


def block_medians(keys: DataFrame, block: int) -> list[tuple]:
    """(median key, rows) of every run of at most ``block`` rows of a partition."""

    def middle(parts):
        columns = [np.concatenate(c) for c in zip(*parts)]
        at = np.lexsort(columns[::-1])[(len(columns[0]) - 1) // 2]
        values = [*(int(c[at]) for c in columns), len(columns[0])]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], names=[*KEY, "rows"])

    def medians(batches):
        parts, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                piece = batch.slice(at, block)
                if held and held + piece.num_rows > block:
                    yield middle(parts)
                    parts, held = [], 0
                parts.append([piece.column(i).to_numpy(zero_copy_only=False) for i in range(len(KEY))])
                held += piece.num_rows
        if held:
            yield middle(parts)

    found = keys.mapInArrow(medians, ", ".join(f"{c} long" for c in [*KEY, "rows"])).collect()
    return [(tuple(r[c] for c in KEY), r["rows"]) for r in found]


def cutoff(keys: DataFrame, place: int, block: int = BLOCK, few: int = FEW) -> tuple | None:
    """The key at ``place`` (from 1) of the ascending order of ``keys``, whose rows all differ; None if there is none.

    Each round settles at least a quarter of the rows left and passes one row a block through the driver. The rows
    left are written anew whenever they are a quarter of the table being read, so all rounds together read little
    more than the table.
    """
    left = keys.count()
    if not 1 <= place <= left:
        return None
    written = left
    while left > few:
        medians = sorted(block_medians(keys, block))
        half, pivot = 0, None
        for key, rows in medians:
            half += rows
            if 2 * half >= left:
                pivot = key
                break
        below = keys.filter(_key() <= _fixed(pivot)).count()
        if below == place:
            return pivot
        if below > place:
            keys, left = keys.filter(_key() < _fixed(pivot)), below - 1
        else:
            keys, left, place = keys.filter(_key() > _fixed(pivot)), left - below, place - below
        if 4 * left <= written and left > few:
            keys, written = stored(keys, "draw-left"), left
    return sorted(tuple(r) for r in keys.select(*KEY).collect())[place - 1]


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... in the order of their keys, sorted by ranges; one count a range reaches the driver."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(shuffle_width(spark), *KEY).sortWithinPartitions(*KEY)
    placed = stored(ordered.withColumn("place", F.monotonically_increasing_id()), "draw")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()
    before = np.concatenate([[0], np.cumsum([r["count"] for r in counts], dtype=np.int64)])
    bases = spark.createDataFrame([(r["part"], int(b)) for r, b in zip(counts, before)], "part long, base long")
    return placed.withColumn("part", part).join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + inside + 1)


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = 10_000,
    longest: int = 1,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    block: int = BLOCK,
    few: int = FEW,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank``, all long.

    Both tables need a column ``text``. Features are runs of 1 to ``longest`` words, repeats counted, in ``buckets``
    buckets by crc32. ``weight`` is the floored mean of the gains of a document's features, 0 without any; ``score``
    adds noise that depends on ``seed`` and ``doc_id``. Of the N rows with at least ``least_words`` words,
    ``percent`` per cent (rounded down) with the highest scores are drawn and get ranks from 1; all others have a null
    rank. Equal scores go to the smaller ``doc_id``, null ids last, then to the smaller hash of the text; rows equal
    in all are interchangeable and are drawn one by one. A null text is an empty one; a null id counts as an empty
    one in the noise. Other columns are ignored, whatever their names. An empty table gives an empty one, an empty
    target a target without features.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest), buckets)
    scored = scores(docs, gain, longest, least_words, seed).withColumn("falling", -F.col("score"))
    scored = scored.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID).cast("long")))
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    able = scored.filter("enough")
    last = cutoff(able.select(*KEY), able.count() * percent // 100, block, few)
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select(*out, none)
    drawn = F.col("enough") & (_key() <= _fixed(last))
    return ranked(scored.filter(drawn)).select(*out, "rank").unionByName(scored.filter(~drawn).select(*out, none))
