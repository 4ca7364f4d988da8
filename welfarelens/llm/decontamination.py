"""Benchmark decontamination by spaced seeds: overlaps with benchmark texts that tolerate substituted words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from welfarelens.llm.kept import word_hash
from welfarelens.llm.tables import small_batches, stored
from welfarelens.llm.token_files import text_batches, text_parts
from welfarelens.session import ship_package

#: Positions that count; the words between them may differ. Together they hit 12 words with any 2 of most choices of
#: substitutions, 15 with 3 and 20 with 4.
MASKS = [(0, 1, 2, 5, 6), (0, 2, 3, 4, 5), (0, 1, 2, 7, 8), (0, 1, 4, 6, 8)]
#: An overlap has so many equal words, and so large a share of its words are equal.
LEAST_WORDS, LEAST_SHARE = 10, 0.8
#: Benchmark text is searched in blocks of about so many bytes, each of which a task holds in memory.
BLOCK_BYTES = 8 << 20
#: Words searched at once.
AT_ONCE = 1 << 17
FILTER_BITS = 22

_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FACTORS = (np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

OVERLAPS = "doc_id long, item_id long, doc_start long, item_start long, length long, matched long"


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits in lower case."""
    return (text or "").lower().encode("utf-8", "replace").translate(_ALNUM).split()


def hashed(texts: list[list[bytes]]) -> np.ndarray:
    get = word_hash()
    return np.fromiter((get(w) for t in texts for w in t), np.uint64, sum(map(len, texts)))


def seeds(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of the counted positions at every place where the mask fits."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for place, factor in zip(mask, _FACTORS):
        out += (tokens[place : place + n] ^ (tokens[place : place + n] >> np.uint64(29))) * factor
    return out ^ (out >> np.uint64(31))


class Benchmark:
    """Seeds of a block of benchmark items: sorted hashes with item and place, behind a bit table."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        self.tokens = [hashed([words(t)]) for _, t in items]
        lengths = [len(t) for t in self.tokens]
        flat = np.concatenate([np.empty(0, np.uint64), *self.tokens])
        owner, first = np.repeat(np.arange(len(items)), lengths), np.cumsum(lengths) - lengths
        self.tables = []
        for mask in MASKS:
            keys = seeds(flat, mask)
            at = np.arange(len(keys))
            own = owner[at] == owner[at + mask[-1]] if len(keys) else np.empty(0, bool)
            keys, at = keys[own], at[own]
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.tables.append((mask, keys, owner[at], at - first[owner[at]] if len(at) else at, bits))

    def _hits(self, tokens: np.ndarray):
        """(place, item, place in the item) of each common seed."""
        for mask, keys, items, places, bits in self.tables:
            if not len(keys):
                continue
            found = seeds(tokens, mask)
            at = np.flatnonzero(bits[(found >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, found[at], "left"), np.searchsorted(keys, found[at], "right")
            counts = hi - lo
            at, lo, counts = at[counts > 0], lo[counts > 0], counts[counts > 0]
            if len(at):
                row = np.repeat(lo, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                yield np.repeat(at, counts), items[row], places[row]

    def overlaps(self, texts: list[str | None]) -> list[dict[int, tuple[int, int, int, int]]]:
        """For each text its best verified overlap with each item: (start, start in the item, words, equal words)."""
        split = [words(t) for t in texts]
        lengths = np.array([len(s) for s in split], np.int64)
        tokens = hashed(split)
        owner, first = np.repeat(np.arange(len(texts)), lengths), np.cumsum(lengths) - lengths
        out: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in texts]
        span = max(m[-1] for m in MASKS)
        pairs = []
        for a in range(0, len(tokens), AT_ONCE):
            for at, item, place in self._hits(tokens[a : a + AT_ONCE + span]):
                doc = owner[a + at]
                pairs.append(np.stack([doc, item, a + at - first[doc] - place], axis=1))
        for doc, item, shift in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []:
            theirs = self.tokens[item]
            lo, hi = max(0, -shift), min(len(theirs), int(lengths[doc]) - shift)
            mine = tokens[first[doc] + shift + lo : first[doc] + shift + hi]
            best = overlap(mine == theirs[lo:hi])
            if best and best[1] > out[doc].get(item, (0, 0, 0, 0))[3]:
                start, matched, length = best
                out[doc][item] = (shift + lo + start, lo + start, length, matched)
        return out


def overlap(equal: np.ndarray) -> tuple[int, int, int] | None:
    """(start, equal words, words) of a stretch with enough words, enough of them equal; None only if there is none."""
    if equal.sum() < LEAST_WORDS:
        return None
    for miss in (-3, -4):  # the milder price spans evenly spread substitutions, the other one never goes below the share
        running = np.concatenate([[0], np.cumsum(np.where(equal, 1, miss))])
        least = np.minimum.accumulate(running)
        end = int(np.argmax(running - least))
        start = int(np.argmin(running[: end + 1]))
        matched = int(equal[start:end].sum())
        if matched >= LEAST_WORDS and matched >= LEAST_SHARE * (end - start):
            return start, matched, end - start
    # the dearest stretch is too short or unlike; of all others the one with the most equal words decides
    running = np.concatenate([[0], np.cumsum(np.where(equal, 1, -4))])  # not below zero: enough words are equal
    counts = np.concatenate([[0], np.cumsum(equal)])
    least = np.minimum.accumulate(running)
    first = np.searchsorted(-least, -running, "left")  # the earliest start that does not end below zero
    matched = counts - counts[first]
    end = int(np.argmax(matched))
    if matched[end] < LEAST_WORDS:
        return None
    start = int(first[end])
    start += int(np.argmax(equal[start:end]))
    return start, int(matched[end]), end - start


def _blocks(spark: SparkSession, benchmark: DataFrame) -> Iterator:
    """Broadcasts of the benchmark's blocks. Each holds about ``BLOCK_BYTES`` of text, so their size is bounded."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // BLOCK_BYTES)
    for block in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Benchmark([(r["item_id"], r["text"]) for r in rows]))


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each document's best overlap with each benchmark item it contains, at least ten words and 80 % of them equal.

    Columns: ``doc_id``, ``item_id``, ``doc_start``, ``item_start``, ``length`` (places and size in words) and
    ``matched``. Substituted words are tolerated, inserted or missing ones end an overlap. Documents without an overlap
    have no row; null and empty texts have none, nor have items of fewer than ten words. Rows with null or repeated
    ids are searched like any other. Other columns are ignored. Nothing is shuffled.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [x.split()[0] for x in OVERLAPS.split(", ")]
    out = spark.createDataFrame([], OVERLAPS)
    for block in _blocks(spark, benchmark):

        def search(batches, block=block):
            for ids, texts in text_batches(batches):
                index = block.value
                found = index.overlaps(texts)
                rows = [(i, index.ids[item], *o) for i, f in zip(ids, found) for item, o in sorted(f.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        out = out.unionByName(source.mapInArrow(search, OVERLAPS))
    return out


def _contaminated(block, text: Column) -> Column:
    @F.pandas_udf(T.BooleanType())
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = texts.tolist()
            found = [bool(o) for a, b in text_parts(texts) for o in block.value.overlaps(texts[a:b])]
            yield pd.Series(found, dtype=bool)

    return found(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item; nothing is shuffled, all columns stay.

    Every row is judged by its own text, also rows that repeat an id; null and empty texts stay. Empty tables change
    nothing, and columns may have any names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    for block in _blocks(spark, benchmark):
        docs = docs.filter(~_contaminated(block, F.col("text").cast("string")))
    with small_batches(spark):
        return stored(docs, "not-contaminated")
