"""Weighted quantiles, entropy, variance parts, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from welfarelens.operators.ordered import last_at_or_below, running_totals


def weighted_quantile(
    df: DataFrame,
    value: str,
    weight: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    floor: float | None = 0.0,
    hit_tolerance: float = 1e-13,
    buckets: int | None = None,
) -> DataFrame:
    """Exact weighted quantiles: rows (by, prob, quantile).

    The quantile is the smallest value whose share of the total weight reaches
    ``prob``; if the share equals ``prob`` (within ``hit_tolerance``) it is the mean
    of that value and the next (a row that weighs less than the tolerance is not told apart from its neighbour). Results are floored at ``floor``. NULL values and
    NULL or non-positive weights are left out.
    """
    by = list(by)
    used = df.filter(F.col(weight) > 0).select(*by, value, weight)
    curve = running_totals(used, value, {"w": F.sum(weight)}, by, buckets, with_totals=True)
    share = curve.select(
        *by, F.col(value).alias("__v"), ((F.col("cum_w") - F.col("w")) / F.col("all_w")).alias("__s")
    )
    # __s is the share of the smaller values. The value at p is the last one with a
    # smaller share than p; on an exact hit the next value has the share p.
    probs = [float(p) for p in probs]
    low = {p: max(p - hit_tolerance, 0.0) for p in probs}
    high = {p: p + hit_tolerance for p in probs}
    # the smallest value has the share 0, so every group has a hit
    hits = last_at_or_below(share, "__v", "__s", [*low.values(), *high.values()], ["__v"], by)

    def at(c: Column) -> Column:
        return F.max(F.when(F.col("threshold") == c, F.col("__v")))

    grid = F.array(
        *[F.struct(F.lit(p).alias("p"), F.lit(low[p]).alias("lo"), F.lit(high[p]).alias("hi")) for p in probs]
    )
    each = hits.withColumn(
        "__g", F.explode(F.filter(grid, lambda g: (g["lo"] == F.col("threshold")) | (g["hi"] == F.col("threshold"))))
    )
    found = each.groupBy(*by, F.col("__g.p").alias("prob")).agg(
        at(F.col("__g.lo")).alias("__lo"), at(F.col("__g.hi")).alias("__hi")
    )
    quantile = (F.col("__lo") + F.col("__hi")) / 2
    if floor is not None:
        quantile = F.greatest(quantile, F.lit(float(floor)))
    return found.select(*by, "prob", quantile.alias("quantile"))


def median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact unweighted median, by the bucketed running count."""
    return (
        weighted_quantile(df.withColumn("__one", F.lit(1.0)), value, "__one", [0.5], by, floor=None)
        .select(*by, F.col("quantile").alias("median"))
    )


def entropy(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Entropy (natural log) of the value distribution, and the bound ln(n rows).

    NULL values are not counted as a value but are rows for the bound.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    c = F.when(F.col(value).isNotNull(), F.col("__c"))
    return counts.groupBy(*by).agg(
        (F.ln(F.sum(c)) - F.sum(c * F.ln(c)) / F.sum(c)).alias("entropy"),
        F.ln(F.sum("__c")).alias("uniform_entropy"),
        F.count(value).alias("distinct_values"),
    )


def variance_decomposition(df: DataFrame, value: str, group: str) -> DataFrame:
    """Within, between and total variance over ``group``, each divided by N - 1.

    N counts all rows. Rows with a NULL group count for the total only.
    """
    stats = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.var_pop(value).alias("var"),
    )
    overall = stats.agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("overall"), F.sum("rows").alias("total_rows")
    )
    joined = stats.crossJoin(F.broadcast(overall))
    inside = F.col("n") * F.col("var")
    spread = F.col("n") * F.pow(F.col("mean") - F.col("overall"), 2)
    named = F.col(group).isNotNull()
    denominator = F.max("total_rows") - 1
    return joined.agg(
        (F.sum(F.when(named, inside)) / denominator).alias("var_within"),
        (F.sum(F.when(named, spread)) / denominator).alias("var_between"),
        (F.sum(inside + spread) / denominator).alias("var_total"),
    )


def histogram(df: DataFrame, value: str, bins: int = 100, log_x: bool = False) -> DataFrame:
    """Counts in ``bins`` equal bins (of log10 if ``log_x``), the maximum in the last bin.

    Returns only the bins that hold rows. ``log_x`` leaves out values <= 0.
    """
    x = F.log10(value) if log_x else F.col(value).cast("double")
    kept = df.filter((F.col(value) > 0) if log_x else F.col(value).isNotNull()).select(x.alias("x"))
    ends = kept.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    placed = kept.crossJoin(F.broadcast(ends)).select(
        F.when(F.col("hi") == F.col("lo"), F.lit(1))
        .otherwise(
            F.least(
                F.lit(bins),
                F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * bins).cast("int") + 1,
            )
        )
        .alias("bin")
    )
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"))


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / sample std per column; a constant column becomes 0, as do NULLs."""
    stats = df.agg(
        *[F.avg(c).alias(f"__m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(c).alias(f"__s_{i}") for i, c in enumerate(columns)],
    )
    scaled = {
        c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{i}"), F.col(f"__s_{i}")), F.lit(0.0))
        for i, c in enumerate(columns)
    }
    return df.crossJoin(F.broadcast(stats)).select(*[scaled.get(c, F.col(c)).alias(c) for c in df.columns])


def binned_mean(df: DataFrame, x: Column, values: Sequence[str], width: float) -> DataFrame:
    """Mean of ``values`` in bins of ``x`` of the given width (a scatter plot as a table)."""
    return (
        df.withColumn("bin", F.floor(x / width).cast("long"))
        .filter(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("rows"), *[F.avg(v).alias(v) for v in values])
    )
