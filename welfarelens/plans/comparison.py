"""Comparison of policy runs: collect, keep the last of repeated runs, label, cap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from welfarelens.operators import curves as C, dedup as U

# fixed values: the columns that tell two runs apart
RUN_KEYS = [
    "policy_type", "unconditional_tolerance", "conditional_tolerance", "d", "nclass", "features", "lambda",
    "n_quantiles", "hidden_layer_size", "scheme", "oracle_gap_scheme", "budget", "method",
]


def collect_runs(
    tables: Mapping[str, DataFrame],
    label: str = "policy_type",
    keys: Sequence[str] = RUN_KEYS,
    order: Sequence[str | Column] = ("run",),
) -> DataFrame:
    """Union of result tables under their labels; of repeated runs the last in ``order`` stays.

    Tables may differ in their columns; a key that no table has is ignored.
    """
    together = U.union_labelled(tables, label)
    return U.keep_last(together, list(keys), list(order))


def compare_with_oracle(
    runs: DataFrame,
    oracle: str,
    level: str,
    cost: str = "policy_cost_per_capita",
    label: str = "policy_type",
    points: int = 40,
    min_cost: float = 0.1,
) -> DataFrame:
    """Cost ratios of every policy to the oracle over the range where the oracle has a sensible cost."""
    ratios = C.cost_ratios(runs, label, oracle, cost, level, points)
    top = runs.filter((F.col(label) == oracle) & (F.col(cost) > min_cost)).agg(F.max(level).alias("__top"))
    return ratios.crossJoin(F.broadcast(top)).filter(F.col(level) <= F.col("__top")).drop("__top")


def subnational_comparison(table: DataFrame, features: str, national: str) -> DataFrame:
    """Rows of the parts of a country beside the national row, most costly first.

    Columns of the national row are prefixed with ``national_``. More than one national row is an error, so the
    cross join adds no rows.
    """
    whole = table.filter(F.col(features) == national)
    if whole.limit(2).count() > 1:
        raise ValueError(f"more than one row has {features} = {national!r}")
    parts = table.filter(F.col(features) != national)
    numbers = [c for c in table.columns if c != features]
    side = whole.select(*[F.col(c).alias(f"national_{c}") for c in numbers])
    return parts.crossJoin(F.broadcast(side)).orderBy(F.desc("policy_cost_per_capita"))
