"""Packing of documents into training sequences: bounded-space online best fit, then merged leftovers."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from welfarelens.llm.encoding import little_endian, read_description
from welfarelens.llm.tables import stored
from welfarelens.llm.token_files import text_batches
from welfarelens.session import ship_package

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, open boolean, ids binary"
#: Sequence ids: the partition's number times this, plus a running number.
PER_PARTITION = 1 << 36
#: Leftovers of so many partitions are merged by one task; a partition leaves a few sequences at most.
MERGED_PARTITIONS = 512


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Indices of ``lengths`` in bins of ``size``: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(rooms, (lengths[i], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > lengths[i]:
            insort(rooms, (room - lengths[i], b))
    return bins


class OpenWindows:
    """At most ``count`` windows that still take pieces.

    A piece goes into the window it fills best. If none has room, the fullest is emitted; a gap of ``least_cut`` ids
    or more is filled before by the head of the piece.
    """

    def __init__(self, size: int, count: int, least_cut: int):
        self.size, self.count, self.least_cut = size, count, least_cut
        self.rooms: list[tuple[int, int]] = []
        self.windows: dict[int, list[tuple]] = {}
        self.made = 0

    def _put(self, room: int, window: int, piece: tuple):
        self.windows.setdefault(window, []).append(piece)
        if room > piece[2]:
            insort(self.rooms, (room - piece[2], window))
            return None
        return self.windows.pop(window)

    def add(self, doc_id, ids: memoryview):
        """Yields full or emitted windows: lists of (doc_id, start, length, doc_tokens, ids)."""
        total, start = len(ids) // 4, 0
        while start < total:
            length = min(total - start, self.size)
            at = bisect_left(self.rooms, (length, -1)) if length < self.size else len(self.rooms)
            if at < len(self.rooms):
                room, window = self.rooms.pop(at)
            elif length == self.size or len(self.windows) < self.count:
                room, window = self.size, self.made
                self.made += 1
            else:
                room, window = self.rooms.pop(0)
                if room < self.least_cut:
                    yield self.windows.pop(window)
                    continue
                length = room
            piece = (doc_id, start, length, total, bytes(ids[4 * start : 4 * (start + length)]))
            if (done := self._put(room, window, piece)) is not None:
                yield done
            start += length

    def close(self):
        """The pieces of the windows still open, packed anew; True marks sequences with a gap of ``least_cut`` or more."""
        pieces = [p for w in self.windows.values() for p in w]
        for chosen in best_fit_decreasing([p[2] for p in pieces], self.size):
            window = [pieces[i] for i in chosen]
            yield window, self.size - sum(p[2] for p in window) >= self.least_cut


def pack(
    docs: DataFrame, tokenizer: str, end_id: int | None, size: int = 2048, open_windows: int = 64, least_cut: int = 16
) -> DataFrame:
    """Pieces of all ``docs`` with their place in sequences of at most ``size`` ids.

    Columns: ``doc_id``, ``start`` (the document's ids before the piece), ``length``, ``doc_tokens``, ``sequence_id``,
    ``offset`` (in the sequence, without gaps) and ``ids`` (little-endian unsigned 32-bit integers). Each partition
    packs its documents in one pass with ``open_windows`` windows in memory; what it leaves unfilled is merged with
    the leftovers of other partitions. A null text is an empty one and still has its end id; without an end id an
    empty text has no piece. Null and repeated ids are kept as they are: each row is packed by itself.
    """
    spark = docs.sparkSession
    ship_package(spark)
    description = spark.sparkContext.broadcast(read_description(tokenizer))
    end = b"" if end_id is None else little_endian([end_id])
    names = [x.split()[0] for x in PIECES.split(", ")]
    arrow = pa.schema([(n, pa.binary() if n == "ids" else pa.bool_() if n == "open" else pa.int64()) for n in names])

    def pack_partition(batches):
        from welfarelens.llm.encoding import Encoder

        encoder = Encoder.of(description.value)
        state = OpenWindows(size, open_windows, least_cut)
        first = TaskContext.get().partitionId() * PER_PARTITION
        rows, made = [], 0

        def emit(window, is_open):
            nonlocal made
            offset = 0
            for doc_id, start, length, total, ids in window:
                rows.append((doc_id, start, length, total, first + made, offset, is_open, ids))
                offset += length
            made += 1

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
            rows.clear()
            return out

        for keys, texts in text_batches(batches):
            for key, ids in zip(keys, encoder.encode(texts)):
                for window in state.add(key, memoryview(ids + end)):
                    emit(window, False)
            if len(rows) > 1000:
                yield batch()
        for window, is_open in state.close():
            emit(window, is_open)
        if rows:
            yield batch()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(source.mapInArrow(pack_partition, PIECES), "pieces")

    def merge(group: pa.Table) -> pa.Table:
        lengths, old = group["length"].to_pylist(), group["sequence_id"].to_pylist()
        # numbers in the upper half of the range of the group's first partition, which that partition never uses
        first = min(old) // PER_PARTITION * PER_PARTITION + PER_PARTITION // 2
        places = [(0, 0)] * len(old)
        for n, chosen in enumerate(best_fit_decreasing(lengths, size)):
            offset = 0
            for i in chosen:
                places[i] = (first + n, offset)
                offset += lengths[i]
        for column, values in zip(("sequence_id", "offset"), zip(*places)):
            at = group.column_names.index(column)
            group = group.set_column(at, column, pa.array(values, pa.int64()))
        return group

    closed = pieces.filter(~F.col("open")).drop("open")
    merged = pieces.filter("open").drop("open")
    group = F.floor(F.col("sequence_id") / F.lit(PER_PARTITION * MERGED_PARTITIONS))
    merged = merged.groupBy(group.alias("merge_group")).applyInArrow(merge, merged.schema)
    return closed.unionByName(merged)
