"""Order-dependent sums without a one-partition sort.

A weighted quantile, an oracle floor or "spend until the budget is gone" all
need a running total over the whole sorted table. A window without partition
keys would pull that table into one task. Here the value range is cut into
buckets at approximate quantiles, each bucket is summed on its own, and the
totals of the earlier buckets are added as an offset. The cuts only balance the
work; the totals are exact whatever the cuts are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from welfarelens.session import shuffle_width, written_once

INF = float("inf")


def interval_index(df: DataFrame, value: str, cuts: Sequence[float], out: str) -> DataFrame:
    """Add ``out`` = number of ``cuts`` that are <= value; NULL and NaN get ``len(cuts) + 1``."""
    # + 0.0 turns -0.0 into 0.0, which the binary search would tell apart
    cuts = sorted(set(float(c) + 0.0 for c in cuts))
    missing = F.col(value).isNull() | F.isnan(F.col(value).cast("double"))
    if not cuts:
        return df.withColumn(out, F.when(missing, F.lit(1)).otherwise(F.lit(0)))
    raw = f"__{out}_in"
    df = df.withColumn(raw, F.when(~missing, F.col(value).cast("double") + F.lit(0.0)))
    split = Bucketizer(splits=[-INF, *cuts, INF], inputCol=raw, outputCol=out, handleInvalid="keep")
    return (
        split.transform(df)
        .withColumn(out, F.when(missing, F.lit(len(cuts) + 1)).otherwise(F.col(out).cast("int")))
        .drop(raw)
    )


def range_cuts(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Approximate quantiles of ``value``: at most ``buckets - 1`` numbers, one Spark job.

    By default there are a few buckets per shuffle partition, so that tasks even out.
    """
    buckets = buckets or min(4096, 4 * shuffle_width(df.sparkSession))
    probs = [i / buckets for i in range(1, buckets)]
    error = max(1e-4, 1.0 / (4 * buckets))
    found = df.select(F.col(value).cast("double").alias("v")).approxQuantile("v", probs, error)
    return sorted(set(found))


def running_totals(
    df: DataFrame,
    value: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    buckets: int | None = None,
    with_totals: bool = False,
    order_key: Column | None = None,
    merged: bool = False,
) -> DataFrame:
    """One row per (by, value) with each sum and its running total ``cum_<name>``.

    With ``merged`` the rows are a written table with one row per (by, value) and the sums in columns of their names.

    ``with_totals`` adds the sums of the whole group as ``all_<name>``. Rows with a
    NULL or NaN value or a NULL group are left out. A value that is not a number
    needs ``order_key``, a number that never falls as the value rises. Equal values are merged first, so
    ties neither skew a bucket nor get an arbitrary order. No task sorts more than
    one bucket of one group, even if one group holds most rows.
    """
    by = list(by)
    known = F.col(value).isNotNull()
    if order_key is None:
        known = known & ~F.isnan(F.col(value).cast("double"))
    df = named_groups(df, by).filter(known)
    place = order_key if order_key is not None else F.col(value)
    # the input is read once; cuts, bucket sums and running sums come from the merged values
    if merged:
        merged = df.select(*by, value, *sums)
    else:
        merged = written_once(df.groupBy(*by, value).agg(*[c.alias(n) for n, c in sums.items()]))
    cuts = range_cuts(merged.select(place.alias("__place")), "__place", buckets)
    merged = interval_index(merged.withColumn("__place", place), "__place", cuts, "__bucket").drop("__place")

    totals = merged.groupBy(*by, "__bucket").agg(*[F.sum(n).alias(f"__t_{n}") for n in sums])
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*(by or [F.lit(0)]))
    extra = [f"all_{n}" for n in sums] if with_totals else []
    offsets = totals.select(
        *by,
        "__bucket",
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0.0)).alias(f"__o_{n}") for n in sums],
        *[F.sum(f"__t_{n}").over(whole).alias(f"all_{n}") for n in sums if with_totals],
    )

    within = W.partitionBy(*by, "__bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    local = merged.select("*", *[F.sum(n).over(within).alias(f"__c_{n}") for n in sums])
    # same keys as the window, so the rows stay where they are
    joined = local.join(offsets, [*by, "__bucket"])
    return joined.select(
        *by,
        value,
        *sums,
        *[(F.col(f"__c_{n}") + F.col(f"__o_{n}")).alias(f"cum_{n}") for n in sums],
        *extra,
    )


def row_places(df: DataFrame, order: Sequence[Column], out: str = "place") -> DataFrame:
    """Add ``out`` = 1, 2, 3... in the order of the given columns, which must tell all rows apart to be reproducible.

    The rows are sorted in ranges and written once; a range's first place is the sum of the sizes of the ranges before
    it, so one number a range reaches the driver and no task holds more than a range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = written_once(ranged).withColumn("__part", F.shiftright("__at", 33))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    bases, before = [], 1
    for r in counts:
        bases.append((r["__part"], before))
        before += r["n"]
    bases = df.sparkSession.createDataFrame(bases, "__part long, __base long")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.join(F.broadcast(bases), "__part").withColumn(out, F.col("__base") + inside)
    return placed.drop("__part", "__at", "__base")


def sums_below(
    df: DataFrame,
    value: str,
    cuts: Sequence[float],
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """For every group and cut: each sum over the rows with ``value < cut``.

    One pass whatever the number of cuts: rows are counted in the interval they
    fall into and the few interval sums are accumulated. Also returns the sum over
    all rows (NULL values included) as ``all_<name>``.
    """
    by = list(by)
    cuts = sorted(set(float(c) for c in cuts))
    placed = interval_index(named_groups(df, by), value, cuts, "__i")
    cells = placed.groupBy(*by, "__i").agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in sums.items()])
    # at most one cell per interval
    groups = cells.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("__i", *sums))).alias("__cells"),
        *[F.sum(n).alias(f"all_{n}") for n in sums],
    )
    each = groups.select(
        *by, F.posexplode(F.array(*[F.lit(c) for c in cuts])).alias("__k", "cut"), "__cells",
        *[f"all_{n}" for n in sums],
    )
    # interval i holds the values between cut i-1 and cut i, so it counts for cut i on
    each = each.withColumn("__cells", F.filter("__cells", lambda x: x["__i"] <= F.col("__k")))

    def added(n: str) -> Column:
        return F.aggregate("__cells", F.lit(0.0), lambda acc, x: acc + x[n])

    return each.select(*by, "cut", *[added(n).alias(f"below_{n}") for n in sums], *[f"all_{n}" for n in sums])


def last_at_or_below(
    curve: DataFrame,
    order: str,
    key: str,
    thresholds: Sequence[float],
    payload: Sequence[str],
    by: Sequence[str] = (),
    groups: DataFrame | None = None,
) -> DataFrame:
    """For every group and threshold: numeric ``payload`` of the last row with key <= threshold.

    The rows of a group have different values of ``order``, and ``key`` rises with
    it. ``groups`` has one row for each group that must appear even if no row
    qualifies (the payload is then NULL); its other columns are kept.
    """
    by = list(by)
    thresholds = sorted(set(float(t) for t in thresholds))
    size = len(thresholds)
    # the first threshold that reaches the key; counted on negated numbers because
    # intervals are closed on the left
    flipped = interval_index(
        curve.withColumn("__neg", -F.col(key)), "__neg", [-t for t in thresholds], "__n"
    ).filter(F.col("__n").between(1, size))
    best = (
        flipped.withColumn("__i", F.lit(size) - F.col("__n"))
        .groupBy(*by, "__i")
        # plain numbers, not a struct: those are aggregated by hash, without a sort
        .agg(F.max(order).alias("__o"), *[F.max_by(c, order).alias(f"__p_{c}") for c in payload])
    )
    # at most one row per threshold
    hit = F.struct("__o", "__i", *[F.col(f"__p_{c}").alias(c) for c in payload])
    lists = best.groupBy(*by).agg(F.collect_list(hit).alias("__hits"))
    extra: list[str] = []
    if groups is not None:
        extra = [c for c in groups.columns if c not in by]
        lists = join_groups(groups, lists, by, "left")
    each = lists.select(
        *by, *extra, F.posexplode(F.array(*[F.lit(t) for t in thresholds])).alias("__k", "threshold"), "__hits"
    )
    each = each.withColumn("__best", F.array_max(F.filter("__hits", lambda x: x["__i"] <= F.col("__k"))))
    return each.select(*by, *extra, "threshold", *[F.col(f"__best.{c}").alias(c) for c in payload])


def named_groups(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows whose group is known. Grouped results have no row for an unknown group."""
    return df.dropna(subset=list(by)) if by else df


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table of one row per group, or of one row in all without keys."""
    return left.join(right, list(keys), how) if keys else left.join(F.broadcast(right), F.lit(True), how)
