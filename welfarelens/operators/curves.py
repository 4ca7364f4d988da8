"""Cost curves: interpolation, ratios, targets, selection of runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from welfarelens.operators.ordered import interval_index


def interpolate(
    curve: DataFrame, x: str, f: str, at: Sequence[float], by: Sequence[str] = (), out: str | None = None
) -> DataFrame:
    """Linear interpolation of f(x) at the given points, clamped at both ends.

    Rows (by, x, out). Points with a NULL x or f are left out. If x repeats, the
    largest f counts to the right of it and the smallest to the left. The curve is
    reduced to two points per interval of the grid before any sort.
    """
    by = list(by)
    out = out or f
    at = sorted(set(float(a) for a in at))
    n = len(at)
    points = curve.filter(F.col(x).isNotNull() & F.col(f).isNotNull()).select(
        *by, F.col(x).cast("double").alias("__x"), F.col(f).cast("double").alias("__f")
    )
    # right-open count: grid points <= x; left-open count from negated numbers
    points = interval_index(points, "__x", at, "__le")
    points = interval_index(points.withColumn("__nx", -F.col("__x")), "__nx", [-a for a in at], "__ge")
    pt = F.struct(F.col("__x").alias("x"), F.col("__f").alias("f"))
    cells = points.groupBy(*by, "__le", "__ge").agg(F.max(pt).alias("hi"), F.min(pt).alias("lo"))
    # at most two cells per grid point
    lists = cells.groupBy(*by).agg(F.collect_list(F.struct("__le", "__ge", "lo", "hi")).alias("__c"))
    rows = lists.select(*by, F.posexplode(F.array(*[F.lit(a) for a in at])).alias("__i", "__q"), "__c")
    # left neighbour from grid index n - #(grid >= x) on, right neighbour up to #(grid <= x) - 1
    left = F.filter("__c", lambda c: F.lit(n) - c["__ge"] <= F.col("__i"))
    right = F.filter("__c", lambda c: c["__le"] - 1 >= F.col("__i"))
    rows = rows.select(
        *by, "__q",
        F.array_max(F.transform(left, lambda c: c["hi"])).alias("lo"),
        F.array_min(F.transform(right, lambda c: c["lo"])).alias("hi"),
    )
    lo, hi = F.col("lo"), F.col("hi")
    slope = F.try_divide(hi["f"] - lo["f"], hi["x"] - lo["x"])
    value = (
        F.when(lo.isNull(), hi["f"])
        .when(hi.isNull() | (lo["x"] == F.col("__q")), lo["f"])
        .otherwise(lo["f"] + slope * (F.col("__q") - lo["x"]))
    )
    return rows.select(*by, F.col("__q").alias(x), value.alias(out))


def shared_maximum(curves: DataFrame, field: str, by: str) -> float:
    """Smallest of the groups' maxima: the end of the range all curves share."""
    row = curves.groupBy(by).agg(F.max(field).alias("m")).filter(F.col(by).isNotNull()).agg(F.min("m")).first()
    return row[0]


def even_points(stop: float, count: int) -> list[float]:
    """``count`` even points from 0 to ``stop``."""
    return [stop * i / (count - 1) for i in range(count)]


def cost_ratios(
    runs: DataFrame,
    policy: str,
    denominator: str,
    desired: str,
    matching: str,
    points: int = 40,
    at: Sequence[float] | None = None,
) -> DataFrame:
    """Ratio of every policy's interpolated ``desired`` to that of one policy.

    The points are even over the range of ``matching`` that all policies share.
    """
    if at is None:
        at = even_points(shared_maximum(runs, matching, policy), points)
    curves = interpolate(runs, matching, desired, at, [policy])
    base = curves.filter(F.col(policy) == denominator).select(
        F.col(matching).alias("__m"), F.col(desired).alias("__base")
    )
    return (
        curves.filter(F.col(policy) != denominator)
        .join(base, F.col(matching) == F.col("__m"))
        .select(policy, matching, F.try_divide(desired, "__base").alias("ratio"))
    )


def with_origin(runs: DataFrame, x: str, start: str, f: str, by: Sequence[str], f_start: float = 0.0) -> DataFrame:
    """Points (by, x, f) of each curve plus its start: the initial level at cost 0."""
    points = runs.select(*by, x, f)
    origin = runs.groupBy(*by).agg(F.max(start).alias(x), F.lit(float(f_start)).alias(f))
    return points.unionByName(origin.select(*by, x, f))


def cost_to_target(
    runs: DataFrame, level: str, initial: str, cost: str, target: float, by: Sequence[str]
) -> DataFrame:
    """Cost at which each curve reaches ``target``, starting at (initial level, 0)."""
    curve = with_origin(runs, level, initial, cost, by)
    return interpolate(curve, level, cost, [target], by).select(
        *by, F.col(level).alias("target"), F.col(cost).alias("cost_at_target")
    )


def cost_table(
    runs: DataFrame, rate: str, gap: str, cost: str, rate_target: float, gap_target: float, by: Sequence[str]
) -> DataFrame:
    """Method by setting table: cost of a target rate and of a target gap."""
    a = interpolate(runs, rate, cost, [rate_target], by, out="rate_cost").select(*by, "rate_cost")
    b = interpolate(runs, gap, cost, [gap_target], by, out="gap_cost").select(*by, "gap_cost")
    return a.join(b, list(by)).withColumn("gap_target", F.lit(float(gap_target)))


def named_ratios(table: DataFrame, key: str, value: str, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row of ratios value[a] / value[b] for named pairs (a, b) of ``key``."""
    def of(name):
        return F.max(F.when(F.col(key) == name, F.col(value)))

    return table.agg(*[F.try_divide(of(a), of(b)).alias(n) for n, (a, b) in pairs.items()])


def cheapest_under_bound(
    runs: DataFrame, bounded: str, bound: float, cost: str, pick: str, by: Sequence[str] = ()
) -> DataFrame:
    """``pick`` of the cheapest run whose ``bounded`` is at most ``bound``."""
    return (
        runs.filter(F.col(bounded) <= bound)
        .groupBy(*by)
        .agg(F.min_by(pick, F.struct(cost, pick)).alias(pick), F.min(cost).alias(cost))
    )


def pick_hyperparameters(
    trials: DataFrame, params: Sequence[str], metric: str, by: Sequence[str] = ()
) -> DataFrame:
    """Parameter set with the smallest mean metric over its trials (first in order on ties)."""
    means = (
        trials.filter(_all_present(params))
        .groupBy(*by, *params)
        .agg(F.avg(metric).alias("__m"))
        .filter(F.col("__m").isNotNull())
    )
    return means.groupBy(*by).agg(
        F.min(F.struct("__m", *params)).alias("__b")
    ).select(*by, *[F.col(f"__b.{p}").alias(p) for p in params], F.col("__b.__m").alias(f"mean_{metric}"))


def _all_present(columns: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return cond


def compare_settings(tuned: DataFrame, default: DataFrame, key: str = "parameter", value: str = "value") -> DataFrame:
    """Outer join of two (parameter, value) tables into parameter, tuned, default."""
    a = tuned.select(F.col(key).alias("__a"), F.col(value).alias("tuned"))
    b = default.select(F.col(key).alias("__b"), F.col(value).alias("default"))
    return a.join(b, F.col("__a").eqNullSafe(F.col("__b")), "full").select(
        F.coalesce("__a", "__b").alias(key), "tuned", "default"
    )


def within_oracle_range(
    runs: DataFrame, policy: str, oracle: str, level: str, cost: str, min_cost: float = 0.1
) -> DataFrame:
    """Runs up to the highest level at which the oracle still costs more than ``min_cost``."""
    top = runs.filter((F.col(policy) == oracle) & (F.col(cost) > min_cost)).agg(F.max(level).alias("__top"))
    return runs.crossJoin(F.broadcast(top)).filter(F.col(level) <= F.col("__top")).drop("__top")


def cost_by_classes(
    runs: DataFrame, method: str, reference: str, dimension: str = "d", classes: str = "nclass", cost: str = "policy_cost"
) -> DataFrame:
    """Cost per number of classes for one method, beside the reference method's cost at the same dimension."""
    ref = (
        runs.filter(F.col("method") == reference)
        .groupBy(dimension)
        .agg(F.min(cost).alias("reference_cost"))
    )
    return (
        runs.filter(F.col("method") == method)
        .select(dimension, classes, cost)
        .join(ref, dimension, "left")
    )
