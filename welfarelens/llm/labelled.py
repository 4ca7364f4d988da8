"""Labelled documents: bounded samples of them for fitting, and their labels for thresholds."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, functions as F

#: One in so many documents is held out of every fit.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are held out: crc32 of its id as text leaves no remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(``__id``, ``__label``) of the labels that are not held out.

    Rows with a null id or label are ignored; of contradicting labels the greater counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("__label"))
    known = known.filter(F.col("__id").isNotNull() & F.col("__label").isin(0, 1) & ~held_out(F.col("__id")))
    return known.groupBy("__id").agg(F.max("__label").alias("__label"))


def texts_by_id(docs: DataFrame) -> DataFrame:
    """(``__id``, ``__text``) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, counts: dict[int, int], max_chars: int) -> tuple[list[tuple[str, int]], float]:
    """At most ``counts[v]`` texts with label ``v`` that are not held out, and the share of label 1 among all such labels.

    The choice is by a hash of the id among the labels whose document exists, so it depends on no order and no label is
    spent on a missing document. Of a text longer than ``max_chars`` a piece of this size from a place chosen by the
    hash is taken (it is scored whole all the same), so what reaches the driver is bounded by the sum of ``counts``
    times ``max_chars``; the chosen ids, whose broadcast is bounded as well, are no more than the sum of ``counts``.
    Rows of ``docs`` that repeat an id may each be chosen. A label without any document is left to the caller and
    warned of.
    """
    known = known_labels(labels, label)
    share = known.agg(F.avg("__label")).first()[0] or 0.0
    present = known.join(docs.select(F.col("doc_id").cast("long").alias("__id")).distinct(), "__id", "left_semi")
    start = F.pmod(F.xxhash64("__id"), F.greatest(F.length("__text") - max_chars + 1, F.lit(1))).cast("int")
    piece = F.when(F.length("__text") > max_chars, F.substring("__text", start + 1, F.lit(max_chars))).otherwise(F.col("__text"))
    rows: list[tuple[str, int]] = []
    for value, count in sorted(counts.items()):
        chosen = present.filter(F.col("__label") == value).orderBy(F.xxhash64("__id"), "__id").limit(count)
        found = texts_by_id(docs).join(F.broadcast(chosen), "__id").withColumn("__text", F.coalesce(piece, F.lit("")))
        texts = found.orderBy(F.xxhash64("__id"), "__id", "__text").limit(count).select("__text").collect()
        if not texts:
            warnings.warn(f"no document with {label} = {value} to learn from", stacklevel=2)
        rows += [(r["__text"], value) for r in texts]
    return rows, float(share)
