"""Duplicates and unions of run tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _keep(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], last: bool) -> DataFrame:
    wanted, keys = keys, [k for k in keys if k in df.columns]
    if not keys:
        raise ValueError(f"none of the key columns {list(wanted)} exists")
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    # an aggregate, not a window: a key with very many copies is reduced before the shuffle
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__r"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in ``order``; NULL keys are equal, missing key columns are ignored."""
    return _keep(df, keys, order, last=False)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Last row per key in ``order``; NULL keys are equal, missing key columns are ignored."""
    return _keep(df, keys, order, last=True)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def conflicting_duplicates(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Duplicate keys in which some column has two different non-NULL values.

    Two different values exist exactly if the minimum differs from the maximum, so
    no distinct count is needed.
    """
    checks = [(F.min(c) < F.max(c)).alias(c) for c in columns]
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), *checks)
    return rows.filter(
        (F.col("copies") > 1) & reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in columns])
    ).select(
        *keys,
        F.concat_ws(",", *[F.when(F.col(c), F.lit(c)) for c in columns]).alias("conflicts"),
    )


def resolve_duplicates(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """First row per key, but an error if duplicates disagree on ``columns``."""
    bad = conflicting_duplicates(df, keys, columns).limit(5).collect()
    if bad:
        raise ValueError(f"duplicate keys disagree, for example {bad}")
    return keep_first(df, keys, order)


def union_labelled(tables: Mapping[str, DataFrame], label: str | None = None) -> DataFrame:
    """Union of tables whose columns differ (missing ones become NULL), tagged with their name."""
    tagged = [t.withColumn(label, F.lit(n)) if label else t for n, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
