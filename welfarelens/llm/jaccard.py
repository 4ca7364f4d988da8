"""Documents whose sets of word shingles have a high Jaccard similarity, by partitioning the universe of shingles.

Two sets of ``a <= b`` shingles at the threshold differ in at most ``H`` of them. Sets are put into bands by size; each
band has a number of segments, more than ``H`` of its largest set, and a hash deals every shingle to one of them. If a
set gives up some segments, takes others as they are and yet others with one shingle more or less, and these choices
are worth over ``H`` in all (nothing, one and two), then any set within ``H`` meets it in one of the segments. Every
set files all its segments, and those of the first few also with each single shingle left out, under its own band and
under the band below if partners may be there; the smaller set of a pair looks for the larger one by the segments that
cost least, judged by how many documents hold the segment's rarest shingle.

Equal keys give candidates. Parities of shingle counts, a lower bound of the difference, rule most wrong ones out, the
rest is verified on whole sets. Sets that crowd under a key are cut into blocks by count and size, and each two blocks
meet in a unit of work that compares their pairs in place and gives a spanning forest of the links, never all pairs. Keys
that hold nearly the same crowd are worked on together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from welfarelens.llm.components import connected_components
from welfarelens.llm.tables import small_batches, stored
from welfarelens.llm.token_files import text_batches
from welfarelens.session import ship_package, shuffle_width

#: A band's largest size over its smallest.
BAND = 1.5
#: Segments of a band that are also filed with one shingle left out.
DELETED = 2
#: Cells of the counts that judge how common a shingle is.
CELLS = 1 << 14
#: Sets under one key that are paired at once; beyond that they are compared in blocks of so many sets and bytes.
TOGETHER, BLOCK, BLOCK_BYTES = 32, 256, 1 << 24
#: Bits of the filter that keeps sets of documents without candidates from being shuffled, and of the parity sketch.
FILTER, PARITIES = 1 << 24, 1024
#: Bytes of a text taken up at once, and of words that are hashed by themselves.
PART, LONG_WORD = 1 << 20, 1 << 12
#: Different sets a task remembers, and rows it gathers.
SEEN, ROWS = 200_000, 1 << 16

LEFT_OUT, PROBES, PROBES_ONE = 1, 2, 4

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits, every one of which depends on all of the input's."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_RANDOM = np.random.default_rng(20240)
_BYTE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(0, 2**63, LONG_WORD, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a UTF-8 text cut at ASCII white space, A-Z in lower case."""
    text, found, at = text.translate(_LOWER), [], 0
    while at < len(text):
        end = text.find(b" ", at + PART)  # parts bound the memory for very long texts
        end = len(text) if end < 0 else end
        part = np.frombuffer(text, np.uint8, end - at, at)
        inside = np.concatenate([[False], part != 32, [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, sizes = turns[::2], turns[1::2] - turns[::2]
        if len(starts):
            first = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            letters = part[part != 32]
            hashes = np.add.reduceat(_BYTE[letters] * _PLACE[place % LONG_WORD], first)
            for n in np.flatnonzero(sizes > LONG_WORD):
                word = text[at + starts[n] : at + starts[n] + sizes[n]]
                hashes[n] = xxhash.xxh64_intdigest(word)
            found.append(mixed(hashes))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Ascending hashes of the different shingles of a text; fewer words are one shingle, none give an empty set."""
    hashes = word_hashes(text or b"")
    if not len(hashes):
        return hashes
    size = min(shingle, len(hashes))
    rolled = np.full(len(hashes) - size + 1, size, np.uint64)
    for at in range(size):
        rolled = rolled * _MULTIPLIER + hashes[at : at + len(rolled)]
    return np.unique(mixed(rolled))


def set_key(found: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8")
    return int(digest[0]), int(digest[1])


def largest_difference(size: int, percent: int) -> int:
    """Most shingles in which a set of this size and one no smaller can differ at the threshold."""
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent)


class Bands:
    """Size bands as (smallest, largest, segments), made as far as they are asked for."""

    def __init__(self, percent: int):
        self.percent, self.bands = percent, []
        self.least = next(n for n in range(1, 200 * percent) if largest_difference(n, percent))

    def of(self, size: int) -> int:
        """The number of a size's band; sizes below ``least`` only match equal sets and have none (-1)."""
        while not self.bands or self.bands[-1][1] < size:
            low = self.bands[-1][1] + 1 if self.bands else self.least
            high = int(low * BAND)
            self.bands.append((low, high, largest_difference(high, self.percent) + 1))
        return next((k for k, band in enumerate(self.bands) if band[0] <= size <= band[1]), -1)

    def filed_under(self, size: int) -> list[int]:
        """The set's own band and those in which smaller partners may be."""
        own = self.of(size)
        return [] if own < 0 else list(range(max(0, self.of(-(-size * self.percent // 100))), own + 1))


def segment_keys(found: np.ndarray, band: int, segments: int, common: np.ndarray | None, documents: int, worth: int):
    """(keys, flags) of a set in a band. With ``common``, how common each shingle is, the set probes for ``worth`` points."""
    segment = ((found >> np.uint64(20)) % np.uint64(segments)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    sizes = np.bincount(segment, minlength=segments)
    starts = np.cumsum(sizes) - sizes
    full = np.flatnonzero(sizes)
    sums = mixed(np.arange(segments, dtype=np.uint64) + np.uint64((band + 1) << 32))
    ordered = found[order]
    sums[full] += np.add.reduceat(ordered, starts[full])
    flags = np.zeros(segments, np.int8)
    first = min(DELETED, segments)
    until = int(sizes[:first].sum())
    shorter = np.repeat(sums[:first], sizes[:first]) - ordered[:until]
    shorter_flags = np.full(until, LEFT_OUT, np.int8)
    if common is not None:
        ranked = common[order]
        cost = np.full(segments, documents, np.int64)
        cost[full] = np.minimum.reduceat(ranked, starts[full])
        more = np.full(first, documents, np.int64)  # what one shingle more or less costs beside the segment itself
        for i in range(first):
            held = np.sort(ranked[starts[i] : starts[i] + sizes[i]])
            if len(held) > 1:
                more[i] = held[0] * len(held) + held[1]
        chosen = np.argsort(np.concatenate([cost, np.maximum(more, cost[:first])]), kind="stable")[:worth]
        flags[chosen[chosen < segments]] |= PROBES
        upgraded = chosen[chosen >= segments] - segments
        flags[upgraded] |= PROBES | PROBES_ONE
        shorter_flags[np.isin(np.repeat(np.arange(first), sizes[:first]), upgraded)] |= PROBES_ONE
    return mixed(np.concatenate([sums, shorter])), np.concatenate([flags, shorter_flags])


def set_keys(found: np.ndarray, bands: Bands, cells: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, flags) of a set in all its bands."""
    size, keys, flags = len(found), [], []
    under = bands.filed_under(size)
    for band in under:
        own = band == under[-1]
        common = cells[(found >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)] if own else None
        k, f = segment_keys(found, band, bands.bands[band][2], common, documents, largest_difference(size, bands.percent) + 1)
        keys.append(k)
        flags.append(f)
    return (np.concatenate(keys), np.concatenate(flags)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int8))


def _meets(smaller, larger) -> np.ndarray:
    """Whether the smaller set's choice covers what the larger one has filed under the same key."""
    whole, other = (smaller & LEFT_OUT) == 0, (larger & LEFT_OUT) == 0
    return (whole & other & ((smaller & PROBES) > 0)) | ((whole != other) & ((smaller & PROBES_ONE) > 0))


def candidate(n: np.ndarray, first: np.ndarray, flags: np.ndarray, u: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows ``u`` and ``v`` of the same key are candidates; ``first`` orders sets of equal size."""
    swap = (n[u] > n[v]) | ((n[u] == n[v]) & (first[u] > first[v]))
    small, large = np.where(swap, v, u), np.where(swap, u, v)
    return (100 * n[small] >= percent * n[large]) & _meets(flags[small], flags[large])


# ---------------------------------------------------------------- passes over the texts


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def _batch(names: list[str], columns, types=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types or [pa.int64()] * len(names))], names=names)


def _sets(batches, shingle: int):
    """(doc_id, set, key, whether the task has met the set lately) of every text."""
    seen: set = set()
    for ids, texts in text_batches(batches):
        for doc_id, text in zip(ids, texts):
            found = shingle_set(text, shingle)
            key = set_key(found)
            known = key in seen
            if len(seen) > SEEN:
                seen.clear()
            seen.add(key)
            yield doc_id, found, key, known


def _members(docs: DataFrame, shingle: int) -> DataFrame:
    """A row per document (size and key of its set), and rows with how many sets of a task have a shingle in a cell."""
    names = ["doc_id", "n", "k1", "k2", "cell", "held"]

    def work(batches):
        cells, rows = np.zeros(CELLS, np.int64), []
        for doc_id, found, key, known in _sets(batches, shingle):
            if not known:
                cells += np.bincount((found >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64), minlength=CELLS)
            rows.append((doc_id, len(found), *key, None, None))
            if len(rows) >= ROWS:
                yield _batch(names, zip(*rows))
                rows = []
        rows += [(None, None, None, None, int(c), int(cells[c])) for c in np.flatnonzero(cells)]
        if rows:
            yield _batch(names, zip(*rows))

    return _texts(docs).mapInArrow(work, ", ".join(f"{c} long" for c in names))


def _filed(docs: DataFrame, shingle: int, percent: int, cells, documents: int) -> DataFrame:
    """The keys under which each different set of a task is filed."""
    names, types = ["key", "k1", "k2", "n", "flags"], [*[pa.int64()] * 4, pa.int8()]

    def work(batches):
        bands, common, parts, held = Bands(percent), cells.value, [], 0
        for _, found, (k1, k2), known in _sets(batches, shingle):
            if known:
                continue
            keys, flags = set_keys(found, bands, common, documents)
            if len(keys):
                parts.append((keys.view(np.int64), *(np.full(len(keys), x, np.int64) for x in (k1, k2, len(found))), flags))
                held += len(keys)
            if held >= ROWS:
                yield _batch(names, map(np.concatenate, zip(*parts)), types)
                parts, held = [], 0
        if parts:
            yield _batch(names, map(np.concatenate, zip(*parts)), types)

    return _texts(docs).mapInArrow(work, "key long, k1 long, k2 long, n long, flags tinyint")


def _needed_sets(docs: DataFrame, shingle: int, needed: DataFrame) -> DataFrame:
    """Hashes and parities of the sets in ``needed`` (k1, k2), each once, with a number of its own."""
    spark = docs.sparkSession
    place = F.pmod("k1", F.lit(FILTER)) + 1
    bits = needed.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    held = np.zeros(FILTER // 8, np.uint8)
    for r in bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect():
        held[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["map"], np.uint8)
    shared = spark.sparkContext.broadcast(held)

    def work(batches):
        held, rows, size = shared.value, [], 0

        def batch():
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return _batch(["k1", "k2", "n", "set", "parities"], zip(*rows), types)

        for _, found, (k1, k2), known in _sets(batches, shingle):
            at = k1 % FILTER
            if known or not held[at >> 3] >> (at & 7) & 1:
                continue
            odd = np.bincount((found & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
            rows.append((k1, k2, len(found), found.tobytes(), np.packbits(odd.astype(np.uint8)).tobytes()))
            size += 8 * len(found) + PARITIES // 8
            if size > 1 << 22:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    found = _texts(docs).mapInArrow(work, "k1 long, k2 long, n long, set binary, parities binary")
    found = found.join(needed, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return stored(found.withColumn("node", F.monotonically_increasing_id()), "shingle-sets")


# ---------------------------------------------------------------- candidates


PAIR = ["a1", "a2", "b1", "b2"]
MET = "a1 long, a2 long, b1 long, b2 long, n long, flags tinyint"


def _paired(filed: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets under a key, and the rows of crowded keys (``n`` is not null, ``b1`` is the key)."""
    names, types = [*PAIR, "n", "flags"], [*[pa.int64()] * 5, pa.int8()]

    def crowded(rows):
        return _batch(names, [rows[1], rows[2], rows[0], np.zeros(len(rows[0]), np.int64), rows[3], rows[4]], types)

    def pairs(rows):
        """Output for complete keys."""
        key, k1, k2, n, flags = rows
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (flags[1:] != flags[:-1])
        key, k1, k2, n, flags = (x[fresh] for x in rows)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        per_row = np.repeat(sizes, sizes)
        if (many := per_row > TOGETHER).any():
            yield crowded([x[many] for x in (key, k1, k2, n, flags)])
        ends = np.where(many, 0, np.repeat(starts + sizes, sizes))
        at, us, vs = np.arange(len(key)), [], []
        for step in range(1, TOGETHER):
            at = at[at + step < ends[at]]
            if not len(at):
                break
            good = candidate(n, k1, flags, at, at + step, percent) & ((k1[at] != k1[at + step]) | (k2[at] != k2[at + step]))
            us.append(at[good])
            vs.append(at[good] + step)
        if us and len(u := np.concatenate(us)):
            v = np.concatenate(vs)
            none = pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int8())
            yield _batch(names, [k1[u], k2[u], k1[v], k2[v], *none], types)

    def work(batches):
        held, size, hot = [], 0, None  # rows of a key that may go on in the next batch, or the crowded key itself
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if hot is not None:
                more = int(np.searchsorted(rows[0] != hot, True))
                if more:
                    yield crowded([x[:more] for x in rows])
                rows = [x[more:] for x in rows]
            if not len(rows[0]):
                continue
            hot = None
            held.append(rows)
            rows = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield from pairs([x[:cut] for x in rows])
            held = [[x[cut:] for x in rows]]
            if len(rows[0]) - cut > 64 * TOGETHER:
                yield crowded(held[0])
                hot, held = rows[0][-1], []
        if held:
            yield from pairs([np.concatenate(x) for x in zip(*held)])

    return filed.repartition("key").sortWithinPartitions("key", "k1", "k2", "flags").mapInArrow(work, MET)


def _crowds(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """(``whole``, ``crowd``, ``node``, ``n``): the sets that must meet, each crowd once.

    Crowded keys that share sets form one crowd (``whole``) if comparing all its sets is less work than comparing
    those of every key by themselves; else each key is a crowd.
    """
    rows = crowded.select(F.col("b1").alias("key"), F.col("a1").alias("k1"), F.col("a2").alias("k2")).distinct()
    rows = stored(rows.join(sets.select("k1", "k2", "n", "node"), ["k1", "k2"]).select("key", "node", "n"), "crowded-keys")
    keys = rows.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("rows"))
    roots = connected_components(rows.join(keys, "key").select("node", "first")).toDF("node", "root")
    named = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = named.groupBy("root", "node").agg(F.first("n").alias("n"))
    work = keys.join(roots.withColumnRenamed("node", "first"), "first", "left").select(F.coalesce("root", "first").alias("root"), "rows")
    work = work.groupBy("root").agg(F.sum(F.col("rows").cast("double") * F.col("rows")).alias("apart"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).cast("double").alias("sets"))
    chosen = work.join(sizes, "root").select("root", (F.col("sets") * F.col("sets") <= F.col("apart")).alias("whole"))
    together = members.join(chosen, "root").filter("whole").select("whole", F.col("root").alias("crowd"), "node", "n")
    single = named.join(chosen, "root").filter("NOT whole").select("whole", F.col("key").alias("crowd"), "node", "n")
    return stored(together.unionByName(single), "crowds")


def _crowd_links(crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that connect all sets of a crowd that links of its pairs connect: a forest from each two blocks."""
    counts = crowds.groupBy("whole", "crowd").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    rows = crowds.drop("n").join(counts, ["whole", "crowd"]).join(sets.select("node", "set", "parities"), "node")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        F.col("whole").cast("int").alias("whole"), "crowd", F.least("mine", "other").alias("low"),
        F.greatest("mine", "other").alias("high"), "mine", "node", "set", "parities",
    )
    unit = ["whole", "crowd", "low", "high"]

    def forest(name, rows):
        """Sets of a unit in ascending size are compared with those that may be alike and are not connected yet."""
        mine, nodes, sets, parities = rows
        n = np.array([len(x) // 8 for x in sets])
        order = np.argsort(n, kind="stable")
        mine, nodes, n, parities = mine[order], nodes[order], n[order], parities[order]
        sets = [np.frombuffer(sets[i], np.uint64) for i in order]
        tree = np.arange(len(n))  # the connected sets of each set, by the least of them
        us, vs = [], []
        for i in range(len(n)):
            until = int(np.searchsorted(n, 100 * n[i] // percent, "right"))
            v = np.arange(i + 1, until)
            if name[2] != name[3]:
                v = v[mine[v] != mine[i]]
            v = v[tree[v] != tree[i]]
            apart = np.bitwise_count(parities[v] ^ parities[i]).sum(axis=1, dtype=np.int64)
            good = apart * (100 + percent) <= (n[i] + n[v]) * (100 - percent)
            for j in v[good][np.argsort(apart[good], kind="stable")].tolist():
                if tree[i] != tree[j] and _alike(sets[i], sets[j], percent):
                    tree[tree == max(tree[i], tree[j])] = min(tree[i], tree[j])
                    us.append(nodes[i])
                    vs.append(nodes[j])
        if us:
            yield _batch(["u", "v"], [us, vs])

    def work(batches):
        held, name = [], None
        for batch in batches:
            at = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5)]
            found = np.array(batch.column(6).to_pylist() + [None], object)[:-1]
            sketch = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(len(at), -1)
            cuts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)])) if len(at) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(at)]):
                if name is not None and tuple(at[lo]) != name:
                    yield from forest(name, [np.concatenate(x) for x in zip(*held)])
                    held = []
                name = tuple(at[lo])
                held.append([*(c[lo:hi] for c in columns), found[lo:hi], sketch[lo:hi]])
        if held:
            yield from forest(name, [np.concatenate(x) for x in zip(*held)])

    width = shuffle_width(rows.sparkSession)
    return rows.repartition(width, *unit).sortWithinPartitions(*unit).mapInArrow(work, "u long, v long")


# ---------------------------------------------------------------- verification


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets are at the threshold."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose whole sets are at the threshold."""

    def work(batches):
        for batch in batches:
            u, v, left, right = (batch.column(i) for i in range(4))
            good = [
                _alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(left, right)
            ]
            kept = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(kept), v.filter(kept)], names=["u", "v"])

    left, right = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "uv")
    return pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "set_u", "set_v").mapInArrow(work, "u long, v long")


def _close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) that the parities do not rule out."""

    def work(batches):
        for batch in batches:
            u, v, nu, nv = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(u), -1) for i in (4, 5))
            apart = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
            good = apart * (100 + percent) <= (nu + nv) * (100 - percent)
            yield _batch(["u", "v"], [u[good], v[good]])

    left, right = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("parities").alias(f"p_{c}")) for c in "uv")
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "n_u", "n_v", "p_u", "p_v")
    return both.mapInArrow(work, "u long, v long")


def jaccard_components(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``.

    A document's set are its different shingles of ``shingle`` words (cut at ASCII white space, A-Z in lower case);
    with fewer words the whole sequence is one shingle. Two documents are linked if the intersection of their sets is
    at least ``percent`` per cent of the union. ``component_id`` is the smallest ``doc_id`` that links lead to, the own
    one included (null if all are null). A null text and one without words have an empty set and no links. Rows that
    repeat an id or a text each keep their row. Columns other than ``doc_id`` and ``text`` are ignored; an empty table
    gives an empty one. Shingles are compared by 64-bit hashes of their words' 64-bit hashes.
    """
    spark = docs.sparkSession
    ship_package(spark)
    table = stored(_members(docs, shingle), "shingle-members")
    members = table.filter("n is not null").select("doc_id", "n", "k1", "k2")
    cells = np.zeros(CELLS, np.int64)
    for r in table.filter("cell is not null").groupBy("cell").agg(F.sum("held").alias("held")).collect():
        cells[r["cell"]] = r["held"]
    filed = _filed(docs, shingle, percent, spark.sparkContext.broadcast(cells), members.count())
    met = stored(_paired(filed, percent), "met-sets")
    few, crowded = met.filter("n is null").select(*PAIR), met.filter("n is not null")
    ends = [few.select(F.col(f"{c}1").alias("k1"), F.col(f"{c}2").alias("k2")) for c in "ab"]
    needed = ends[0].unionByName(ends[1]).unionByName(crowded.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")))
    sets = _needed_sets(docs, shingle, stored(needed.distinct(), "needed-sets"))
    pairs = few.distinct()
    for c, name in zip("ab", "uv"):
        pairs = pairs.join(sets.select(F.col("k1").alias(f"{c}1"), F.col("k2").alias(f"{c}2"), F.col("node").alias(name)), [f"{c}1", f"{c}2"])
    pairs = stored(_close(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), sets, percent), "shingle-pairs")
    crowds = _crowds(crowded, sets)
    with small_batches(spark, 64):  # of whole sets
        links = stored(_linked(pairs, sets, percent).unionByName(_crowd_links(crowds, sets, percent)), "shingle-links")
    roots = connected_components(links)

    classes = members.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    # only sets with candidates have a node; the others keep their own least id and meet no join on it
    rooted = sets.select("k1", "k2", "node").join(roots.select(F.col("u").alias("node"), "v"), "node", "left")
    rooted = rooted.select("k1", "k2", F.coalesce("v", "node").alias("root"))
    ids = rooted.join(classes, ["k1", "k2"]).groupBy("root").agg(F.min("least").alias("named"))
    classes = classes.join(rooted.join(ids, "root").select("k1", "k2", "named"), ["k1", "k2"], "left")
    classes = classes.select("k1", "k2", F.coalesce("named", "least").alias("least"))
    named = members.join(classes, ["k1", "k2"])
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
