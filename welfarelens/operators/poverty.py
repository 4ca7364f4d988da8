"""Weighted poverty statistics.

A household is poor if its outcome is strictly below the line. A NULL outcome is
never poor, but its weight counts in the denominator.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from welfarelens.operators.ordered import named_groups, sums_below


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shortfall(outcome: str | Column, line: float | Column) -> Column:
    """max(line - outcome, 0); NULL for a NULL outcome."""
    y = col(outcome)
    gap = (line if isinstance(line, Column) else F.lit(float(line))) - y
    return F.when(y.isNotNull(), F.greatest(gap, F.lit(0.0)))


def poverty_rate(outcome: str | Column, weight: str | Column, line: float) -> Column:
    """Aggregate: weighted headcount rate."""
    return F.try_divide(F.coalesce(F.sum(F.when(col(outcome) < line, col(weight))), F.lit(0.0)), F.sum(col(weight)))


def mean_gap(outcome: str | Column, weight: str | Column, line: float) -> Column:
    """Aggregate: weighted mean shortfall, in the unit of the outcome."""
    return F.try_divide(
        F.coalesce(F.sum(shortfall(outcome, line) * col(weight)), F.lit(0.0)), F.sum(col(weight))
    )


def gap_index(outcome: str | Column, weight: str | Column, line: float) -> Column:
    """Aggregate: mean shortfall as a share of the line."""
    return mean_gap(outcome, weight, line) / F.lit(float(line))


def weighted_mean(x: str | Column, weight: str | Column) -> Column:
    """Aggregate: sum(w x) / sum(w)."""
    return F.try_divide(F.sum(col(weight) * col(x)), F.sum(col(weight)))


def gap_to_index(gap: str | Column, line: float) -> Column:
    """Mean shortfall to gap index in percent."""
    return col(gap) * 100.0 / F.lit(float(line))


def poverty_table(df: DataFrame, outcome: str, weight: str, line: float, by: Sequence[str] = ()) -> DataFrame:
    """Rate, mean gap, gap index, weighted mean outcome and household count per group."""
    return named_groups(df, by).groupBy(*by).agg(
        poverty_rate(outcome, weight, line).alias("poverty_rate"),
        mean_gap(outcome, weight, line).alias("poverty_gap"),
        gap_index(outcome, weight, line).alias("poverty_gap_index"),
        weighted_mean(outcome, weight).alias("mean_outcome"),
        F.count(F.lit(1)).alias("households"),
    )


def survey_metrics(
    df: DataFrame,
    outcome: str,
    weight: str,
    entity: str,
    lines: Mapping[str, tuple[float, str | None]],
) -> DataFrame:
    """Rate and gap index per entity at several lines in one aggregation.

    ``lines`` maps a suffix to (line, factor column); the outcome is multiplied by
    the factor (for example a price-base conversion) before it meets the line. An
    entity without a factor has NULL results at that line.
    """
    aggs = []
    for suffix, (line, factor) in lines.items():
        y = col(outcome) if factor is None else col(outcome) * col(factor)
        known = F.lit(True) if factor is None else F.max(col(factor)).isNotNull()
        aggs += [
            F.when(known, poverty_rate(y, weight, line)).alias(f"poverty_rate_{suffix}"),
            F.when(known, gap_index(y, weight, line)).alias(f"poverty_gap_index_{suffix}"),
        ]
    return named_groups(df, [entity]).groupBy(entity).agg(*aggs)


def poverty_at_lines(
    df: DataFrame, outcome: str, weight: str, lines: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Rate and mean gap at many lines, one pass whatever their number."""
    below = sums_below(
        df, outcome, lines,
        {"w": F.sum(weight), "wy": F.sum(F.col(weight) * F.col(outcome))}, by,
    )
    return below.select(
        *by,
        F.col("cut").alias("line"),
        F.try_divide("below_w", "all_w").alias("poverty_rate"),
        F.try_divide(F.col("cut") * F.col("below_w") - F.col("below_wy"), "all_w").alias("poverty_gap"),
    )


def describe_outcome(df: DataFrame, outcome: str) -> DataFrame:
    """Mean, sample std, min, max, sum and count of the outcome."""
    return df.agg(
        F.avg(outcome).alias("mean"),
        F.stddev_samp(outcome).alias("std"),
        F.min(outcome).alias("min"),
        F.max(outcome).alias("max"),
        F.sum(outcome).alias("sum"),
        F.count(outcome).alias("count"),
    )


def subset_means(df: DataFrame, value: str, subsets: Mapping[str, Column]) -> DataFrame:
    """Mean of ``value`` in several named subsets, one scan."""
    return df.agg(*[F.avg(F.when(cond, F.col(value))).alias(name) for name, cond in subsets.items()])
