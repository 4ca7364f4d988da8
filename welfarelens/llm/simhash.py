"""Near-duplicates by SimHash fingerprints, found by a grid over their segments' bit counts.

A fingerprint of 64 bits is embedded as the bit counts of its 32 segments of two bits. The Manhattan distance of two
embeddings is a lower bound of the fingerprints' Hamming distance. Within 4 bits, the 16 segments of the upper or of
the lower half are within a Manhattan distance of 2, so the two points share a grid cell once each enters its own cell
and those one step away. Cells give candidates; the exact distance decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from welfarelens.llm.components import connected_components
from welfarelens.llm.tables import fresh, small_batches, stored
from welfarelens.llm.token_files import text_batches
from welfarelens.session import ship_package

SEED = 42
#: Shingles hashed at once, which bounds a task's memory for very long texts.
AT_ONCE = 1 << 15
#: The grid's radius of one step on either side joins points up to this far apart in one half.
HALF_DISTANCE = 2
PAIRS_UP_TO = 48
_ODD_BITS = np.uint64(0x5555555555555555)


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z in lower case, cut at ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def fingerprint(text: str | None, shingle: int) -> int:
    """A bit is 1 if it is set in over half of the hashes of all shingles, repeats included."""
    found = words(text)
    if not found:
        return 0
    size = min(shingle, len(found))
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[size - 1 :]
    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(ends)
    for at in range(0, total, AT_ONCE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(``doc_id``, ``fp``): the fingerprint of every row's whole text as a signed long. A null text is an empty one."""
    ship_package(docs.sparkSession)

    def compute(batches):
        for ids, texts in text_batches(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(compute, "doc_id long, fp long")


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fingerprint) of every grid cell a fingerprint enters: its own of either half and those one step away."""
    counts = (fps & _ODD_BITS) + ((fps >> np.uint64(1)) & _ODD_BITS)  # 32 counts of 0 to 2, two bits each
    out_cells, out_fps = [], []
    for half in (0, 1):
        own = (counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        name = np.uint64(half) << np.uint64(32)
        out_cells.append(own | name)
        out_fps.append(fps)
        for segment in range(16):
            step = np.uint64(1) << np.uint64(2 * segment)
            count = (own >> np.uint64(2 * segment)) & np.uint64(3)
            for room, moved in ((count < 2, own + step), (count > 0, own - step)):
                out_cells.append(moved[room] | name)
                out_fps.append(fps[room])
    return np.concatenate(out_cells), np.concatenate(out_fps)


def _spanning_links(fps: np.ndarray, distance: int):
    """Links that connect what is connected by pairs within ``distance``: one less than the members of a group."""
    left, froms, tos = fps, [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                hits = left[near]
                front.extend(hits)
                froms.append(np.full(len(hits), x))
                tos.append(hits)
                left = left[~near]
    return froms, tos


def verified(cell: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of the same cell; ``cell`` is sorted. Crowded cells give spanning links only."""
    froms, tos = [], []
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(cell)]]))
    for s, n in zip(starts[sizes > PAIRS_UP_TO], sizes[sizes > PAIRS_UP_TO]):
        a, b = _spanning_links(np.unique(fps[s : s + n]), distance)
        froms += a
        tos += b
    small = sizes <= PAIRS_UP_TO
    left = np.repeat(np.where(small, starts + sizes, 0), sizes)  # the end of the row's cell
    at = np.arange(len(cell))
    for step in range(1, PAIRS_UP_TO):
        at = at[at + step < left[at]]
        if not len(at):
            break
        near = np.bitwise_count(fps[at] ^ fps[at + step]) <= distance
        froms.append(fps[at[near]])
        tos.append(fps[at[near] + step])
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *froms]), np.concatenate([empty, *tos])


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (``u``, ``v``) that connect all different fingerprints (column ``fp``) at most ``distance`` bits apart.

    Pairs that share a cell with few others are all given; a crowded cell gives a spanning forest of its pairs, so
    what is connected stays so and rows never grow with the square of a group.
    """
    if distance > 2 * HALF_DISTANCE:
        raise ValueError(f"the grid covers distances up to {2 * HALF_DISTANCE}")
    ship_package(fps.sparkSession)

    def enter(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 20_000):
                cell, fp = cells(values[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp.view(np.int64))], names=["cell", "fp"])

    def verify(batches):
        held = (np.empty(0, np.uint64), np.empty(0, np.uint64))
        parts, last = [], None

        def done(cell, fp):
            u, v = verified(cell, fp, distance)
            pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            cell, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if not len(cell):
                continue
            if last is not None and cell[0] == cell[-1] == last:  # a cell longer than a batch: gather its pieces
                parts.append((cell, fp))
                continue
            parts.append((cell, fp))
            cell, fp = (np.concatenate(x) for x in zip(held, *parts))
            cut = int(np.searchsorted(np.flip(cell != cell[-1]), True))  # rows of the last cell
            cut = len(cell) - cut
            held, parts, last = (cell[cut:], fp[cut:]), [], cell[-1]
            if cut:
                yield done(cell[:cut], fp[:cut])
        cell, fp = (np.concatenate(x) for x in zip(held, *parts))
        if len(cell):
            yield done(cell, fp)

    entered = fps.select("fp").distinct().mapInArrow(enter, "cell long, fp long")
    return entered.repartition("cell").sortWithinPartitions("cell").mapInArrow(verify, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp``, ``component_id`` and ``component_key``.

    Documents are linked if their fingerprints differ in at most ``distance`` bits, and are in the same component if
    links lead from one to the other. ``component_id`` is the smallest ``doc_id`` of the component (null if all are
    null), ``component_key`` its smallest fingerprint. Empty and null texts have fingerprint 0. Rows with the same id
    or the same text each keep their row. Columns other than ``doc_id`` and ``text`` are ignored; an empty table gives
    an empty one.
    """
    with small_batches(docs.sparkSession):
        fps = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(fps, distance)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    nodes = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("component_key"))
    ids = nodes.groupBy("component_key").agg(F.min("least").alias("component_id"))
    named = nodes.drop("least").join(ids, "component_key")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "component_key")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one row of each component: the one whose ``doc_id`` is the component's id.

    Rows that repeat that id count once; a component without ids keeps one of its rows. All columns stay.
    """
    no_id = F.lit(-(2**63)).cast("long")
    found = near_duplicates(docs, shingle, distance)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    key, root = fresh(docs, "__key"), fresh(docs, "__root")
    kept = kept.select(F.coalesce("doc_id", no_id).alias(key), F.col("component_key").alias(root)).distinct()
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), no_id))
    return rows.join(kept, key).dropDuplicates([key, root]).select(*docs.columns)
