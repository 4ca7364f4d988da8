"""Token-id files: flat unsigned integers and 64-bit document offsets that readers map into memory.

A folder holds, for each partition in ascending ``doc_id``:

* ``<part>.bin``: the ids of its documents one after another, little-endian, 16 bits wide if every id fits, else 32
* ``<part>.idx``: little-endian 64-bit integers: layout version, bytes per id, documents, documents whose id is null
  (they come first), ``documents + 1`` offsets into the ``.bin`` counted in ids, then the document ids
* ``manifest``: a Parquet table with a row per file. Only files it names count; those of lost tasks are never read.

A file's base, the ids before it in the whole corpus, is the prefix sum of the counts in the manifest.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from welfarelens.llm.encoding import little_endian, read_description
from welfarelens.session import ship_package

LAYOUT = 1
HEADER = 4
#: Text taken up at once, and rows.
BATCH_BYTES, BATCH_ROWS = 1 << 21, 1000

MANIFEST = "part long, file string, docs long, tokens long"


def _filesystem(folder: str):
    """The file system of a folder's address and the path in it; executors must share it."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def text_batches(batches, limit: int = BATCH_BYTES):
    """(ids, texts) with few MB of text each, however long single texts are."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            rows = batch.slice(at, BATCH_ROWS)
            ids, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for lo, hi in text_parts(texts, limit):
                yield ids[lo:hi], texts[lo:hi]


def text_parts(texts: list, limit: int = BATCH_BYTES):
    """(first, end) of runs of texts that hold about ``limit`` characters, or a single longer text."""
    first, size = 0, 0
    for n, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield first, n + 1
            first, size = n + 1, 0
    if first < len(texts):
        yield first, len(texts)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None) -> DataFrame:
    """Encode ``text`` of all ``docs`` in ascending ``doc_id`` and write the files. Returns the manifest.

    A null text is an empty one; null ids come first; equal ids are ordered by a hash of the text, and rows equal in
    both are interchangeable. Every row gets an entry. Other columns are ignored. An empty table gives an empty
    manifest. Files of a task that runs twice have different names, and only one set enters the manifest.
    """
    spark = docs.sparkSession
    ship_package(spark)
    description = spark.sparkContext.broadcast(read_description(tokenizer))
    end = b"" if end_id is None else little_endian([end_id])

    def write(batches):
        from welfarelens.llm.encoding import Encoder

        encoder = Encoder.of(description.value)
        wide = max(encoder.size - 1, end_id or 0) > 0xFFFF
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        fs, path = _filesystem(folder)
        keys, ends, total, nulls, out = [], [0], 0, 0, None
        for ids, texts in text_batches(batches):
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}.bin")
            for i, b in zip(ids, encoder.encode(texts)):
                b += end
                total += len(b) // 4
                out.write(b if wide else np.frombuffer(b, "<u4").astype("<u2").tobytes())
                nulls += i is None
                keys.append(0 if i is None else i)
                ends.append(total)
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{path}/{name}.idx") as idx:
            idx.write(np.array([LAYOUT, 4 if wide else 2, len(keys), nulls, *ends], "<i8").tobytes())
            idx.write(np.array(keys, "<i8").tobytes())
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "file": [name], "docs": [len(keys)], "tokens": [total]},
            schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]),
        )

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def open_file(folder: str, name: str):
    """(document ids, nulls first, offsets, ids) of one file, mapped into memory where the file system is local."""
    fs, path = _filesystem(folder)
    local = fs.type_name == "local"

    def flat(suffix: str, dtype: str):
        if fs.get_file_info(f"{path}/{name}{suffix}").size == 0:
            return np.empty(0, dtype)
        if local:
            return np.memmap(f"{path}/{name}{suffix}", dtype, "r")
        with fs.open_input_file(f"{path}/{name}{suffix}") as f:
            return np.frombuffer(f.read(), dtype)

    index = flat(".idx", "<i8")
    layout, width, docs, nulls = index[:HEADER].tolist()
    if layout != LAYOUT:
        raise ValueError(f"{name}: unknown layout {layout}")
    return index[HEADER + docs + 1 :], nulls, index[HEADER : HEADER + docs + 1], flat(".bin", f"<u{width}")


def token_bases(manifest: DataFrame) -> list[tuple[str, int]]:
    """(file, ids before it), by prefix sums. One row per file reaches the driver."""
    rows = manifest.orderBy("part").collect()
    before = np.concatenate([[0], np.cumsum([r["tokens"] for r in rows], dtype=np.int64)]) if rows else []
    return [(r["file"], int(b)) for r, b in zip(rows, before)]


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``.

    ``ids`` are little-endian unsigned 32-bit integers.
    """
    ship_package(spark)
    schema = "doc_id long, start long, n_tokens long, ids binary"
    files = token_bases(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"))
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, nulls, ends, ids = open_file(folder, name)
                rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                size = 0
                for k in range(len(keys)):
                    lo, hi = int(ends[k]), int(ends[k + 1])
                    rows["doc_id"].append(None if k < nulls else int(keys[k]))
                    rows["start"].append(base + lo)
                    rows["n_tokens"].append(hi - lo)
                    rows["ids"].append(ids[lo:hi].astype("<u4").tobytes())
                    size += hi - lo
                    if size > BATCH_BYTES or k == len(keys) - 1:
                        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]))
                        rows, size = {c: [] for c in rows}, 0

    listed = spark.createDataFrame(files, "file string, base long")
    return listed.repartition(len(files)).mapInArrow(read, schema)
