"""Joins in which many rows of one table crowd under few keys of the other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Rows of a key that are joined as one piece.
CROWD = 1 << 14
#: Most keys that are cut. What the next key holds is less than the table's rows over this number.
CROWDED_KEYS = 1 << 14


def crowded_keys(many: DataFrame, keys: Sequence[str], crowd: int | None = None) -> DataFrame | None:
    """The most crowded keys and their rows (``__rows``), at most ``CROWDED_KEYS`` of them; None if no key is crowded.

    Rows are counted before the shuffle, and only this bounded list reaches the driver, so it may be broadcast.
    """
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > (crowd or CROWD))
    found = counts.orderBy(F.col("__rows").desc()).limit(CROWDED_KEYS).collect()
    return many.sparkSession.createDataFrame(found, counts.schema) if found else None


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], right_keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on pairs of key names that drops the right keys."""
    right = right.withColumnsRenamed({k: f"__right_{i}" for i, k in enumerate(right_keys)})
    on = [F.col(k) == F.col(f"__right_{i}") for i, k in enumerate(keys)]
    return left.join(right, on, how).drop(*[f"__right_{i}" for i in range(len(keys))])


def split_join(
    many: DataFrame,
    few: DataFrame,
    keys: Sequence[str],
    few_keys: Sequence[str],
    spread: Sequence[str],
    crowd: int | None = None,
) -> DataFrame:
    """Inner join in which crowded keys of ``many`` are cut into pieces by a hash of the columns ``spread``.

    ``few`` repeats its rows of such a key for every piece, so it should have few rows a key. ``many`` is read once
    more for the counts. The columns are those of ``many`` and those of ``few`` without its keys.
    """
    hot = crowded_keys(many, keys, crowd)
    if hot is None:
        return matched(many, few, keys, few_keys)
    hot = F.broadcast(hot.withColumn("__pieces", F.ceil(F.col("__rows") / (crowd or CROWD)).cast("int")).drop("__rows"))
    pieces = F.coalesce("__pieces", F.lit(1))
    many = matched(many, hot, keys, keys, "left").withColumn("__piece", F.pmod(F.xxhash64(*spread), pieces).cast("int"))
    few = matched(few, hot, few_keys, keys, "left").withColumn("__piece_of", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return matched(
        many.drop("__pieces"), few.drop("__pieces"), [*keys, "__piece"], [*few_keys, "__piece_of"]
    ).drop("__piece")

