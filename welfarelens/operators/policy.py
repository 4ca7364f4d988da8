"""Evaluation of cash-transfer policies.

Gaps here are mean shortfalls in the unit of the outcome (not divided by the
line) and costs are per person, sum(w t) / sum(w). The selection rules of the
two oracles, of the fixed transfer and of the proxy-means test are this
library's own definitions; they are stated at each function.

A budget grid never multiplies the households: every policy below orders the
poor once and reads all budgets off the running totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from welfarelens.operators.ordered import join_groups, last_at_or_below, named_groups, running_totals, sums_below
from welfarelens.operators.poverty import mean_gap, poverty_at_lines, poverty_rate, shortfall
from welfarelens.session import written_once

RESULT_COLUMNS = [
    "initial_poverty_rate",
    "initial_poverty_gap",
    "post_transfer_poverty_gap",
    "post_transfer_poverty_rate",
    "policy_cost_per_capita",
]


def evaluate_transfer(
    df: DataFrame, outcome: str, weight: str, transfer: str | Column, line: float, by: Sequence[str] = ()
) -> DataFrame:
    """Poverty before and after adding a transfer column, and its cost per person."""
    t = F.col(transfer) if isinstance(transfer, str) else transfer
    t = F.coalesce(t, F.lit(0.0))
    after = F.col(outcome) + t
    return named_groups(df, by).groupBy(*by).agg(
        poverty_rate(outcome, weight, line).alias("initial_poverty_rate"),
        mean_gap(outcome, weight, line).alias("initial_poverty_gap"),
        mean_gap(after, weight, line).alias("post_transfer_poverty_gap"),
        poverty_rate(after, weight, line).alias("post_transfer_poverty_rate"),
        F.try_divide(F.sum(F.col(weight) * t), F.sum(weight)).alias("policy_cost_per_capita"),
    )


def uniform_transfer(
    df: DataFrame, outcome: str, weight: str, line: float, budgets: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Everybody gets ``budget``: rate and gap at the lines ``line - budget``."""
    by = list(by)
    grid = poverty_at_lines(df, outcome, weight, [line] + [line - b for b in budgets], by)
    named = _lookup(F.col("line"), {line - b: float(b) for b in budgets})
    # one row per budget and group
    whole = W.partitionBy(*(by or [F.lit(0)]))
    at_line = F.col("line") == line
    return grid.select(
        *by,
        named.alias("budget"),
        F.max(F.when(at_line, F.col("poverty_rate"))).over(whole).alias("initial_poverty_rate"),
        F.max(F.when(at_line, F.col("poverty_gap"))).over(whole).alias("initial_poverty_gap"),
        F.col("poverty_gap").alias("post_transfer_poverty_gap"),
        F.col("poverty_rate").alias("post_transfer_poverty_rate"),
        named.alias("policy_cost_per_capita"),
    ).filter(F.col("budget").isNotNull())


def _lookup(c: Column, values: Mapping[float, float]) -> Column:
    pairs = []
    for k, v in values.items():
        pairs += [F.lit(float(k)), F.lit(float(v))]
    return F.create_map(*pairs)[c]


def _summary(df: DataFrame, outcome: str, weight: str, line: float, by: Sequence[str]) -> DataFrame:
    """Weights by (group, outcome of the poor), written once: all that a policy needs to know about the households.

    ``outcome`` is NULL in the row of those who are not poor. ``w`` and ``wy`` add up positive weights only, as those
    alone can be served; ``all_w`` and ``all_wy`` all weights, as in the denominators.
    """
    w, y = F.col(weight).cast("double"), F.col(outcome)
    served = w > 0
    return written_once(
        named_groups(df, by).select(*by, F.when(y < line, y).alias(outcome), w.alias("__w"), (w * y).alias("__wy"), served.alias("__in"))
        .groupBy(*by, outcome).agg(
            F.sum(F.when(F.col("__in"), F.col("__w"))).alias("w"), F.sum(F.when(F.col("__in"), F.col("__wy"))).alias("wy"),
            F.sum("__w").alias("all_w"), F.sum("__wy").alias("all_wy"),
        )
    )


def _poor_curve(summary: DataFrame, outcome: str, by: Sequence[str]):
    """The poor in ascending outcome with running totals, and one totals row per group."""
    by, poor = list(by), F.col(outcome).isNotNull()
    served = summary.filter(poor & F.col("w").isNotNull())
    curve = running_totals(served, outcome, {"w": F.sum("w"), "wy": F.sum("wy")}, by, merged=True)
    totals = summary.groupBy(*by).agg(
        F.sum("all_w").alias("all_w"),
        F.coalesce(F.sum(F.when(poor, F.col("all_w"))), F.lit(0.0)).alias("poor_w"),
        F.coalesce(F.sum(F.when(poor, F.col("all_wy"))), F.lit(0.0)).alias("poor_wy"),
    )
    return curve, totals


def _before(line: float) -> dict[str, Column]:
    return {
        "initial_poverty_rate": F.col("poor_w") / F.col("all_w"),
        "initial_poverty_gap": (line * F.col("poor_w") - F.col("poor_wy")) / F.col("all_w"),
    }


def oracle_gap(
    df: DataFrame,
    outcome: str,
    weight: str,
    line: float,
    budgets: Sequence[float],
    by: Sequence[str] = (),
    floor_on_data: bool = False,
) -> DataFrame:
    """Cheapest cut of the gap with known outcomes: raise the poorest to a common floor.

    The floor is the highest one the budget pays for, capped at the line; with
    ``floor_on_data`` it is the highest observed outcome (or the line) the budget
    pays for. The gap falls one for one with the cost and the rate stays until the
    whole gap is paid.
    """
    by = list(by)
    curve, totals = _poor_curve(_summary(df, outcome, weight, line, by), outcome, by)
    v = F.col(outcome)
    priced = join_groups(curve, totals, by).select(
        *by, outcome, "cum_w", "cum_wy",
        ((v * F.col("cum_w") - F.col("cum_wy")) / F.col("all_w")).alias("cost"),
    )
    out = last_at_or_below(priced, outcome, "cost", budgets, [outcome, "cum_w", "cum_wy", "cost"], by, totals)
    out = out.withColumns(_before(line))
    full = F.col("initial_poverty_gap")
    budget = F.col("threshold")
    paid_in_full = budget >= full - 1e-12
    if floor_on_data:
        level, spent = F.col(outcome), F.col("cost")
    else:
        level = F.least(
            F.lit(float(line)), F.try_divide(budget * F.col("all_w") + F.col("cum_wy"), F.col("cum_w"))
        )
        spent = F.least(budget, full)
    spent = F.when(paid_in_full, full).otherwise(F.coalesce(spent, F.lit(0.0)))
    return out.select(
        *by,
        budget.alias("budget"),
        F.when(paid_in_full, F.lit(float(line))).otherwise(level).alias("floor"),
        "initial_poverty_rate",
        "initial_poverty_gap",
        (full - spent).alias("post_transfer_poverty_gap"),
        F.when(paid_in_full, F.lit(0.0)).otherwise(F.col("initial_poverty_rate")).alias("post_transfer_poverty_rate"),
        spent.alias("policy_cost_per_capita"),
    )


def oracle_gap_transfer(outcome: str | Column, floor: str | Column) -> Column:
    """Transfer that lifts a household to the floor."""
    y = F.col(outcome) if isinstance(outcome, str) else outcome
    level = F.col(floor) if isinstance(floor, str) else floor
    return F.coalesce(F.greatest(level - y, F.lit(0.0)), F.lit(0.0))


def oracle_rate(
    df: DataFrame, outcome: str, weight: str, line: float, tolerances: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Cheapest way to leave at most a given share poor, with known outcomes.

    Households nearest the line are lifted to it first. The ones left are the
    poorest, as many as fit into the tolerance; equal outcomes are treated alike.
    """
    by = list(by)
    curve, totals = _poor_curve(_summary(df, outcome, weight, line, by), outcome, by)
    shares = join_groups(curve, totals, by).select(
        *by, outcome, "cum_w", "cum_wy", (F.col("cum_w") / F.col("all_w")).alias("share")
    )
    out = last_at_or_below(shares, outcome, "share", tolerances, [outcome, "cum_w", "cum_wy"], by, totals)
    out = out.withColumns(_before(line))
    w, wy = F.coalesce("cum_w", F.lit(0.0)), F.coalesce("cum_wy", F.lit(0.0))
    gap = (line * w - wy) / F.col("all_w")
    return out.select(
        *by,
        F.col("threshold").alias("tolerance"),
        "initial_poverty_rate",
        "initial_poverty_gap",
        gap.alias("post_transfer_poverty_gap"),
        (w / F.col("all_w")).alias("post_transfer_poverty_rate"),
        (F.col("initial_poverty_gap") - gap).alias("policy_cost_per_capita"),
    )


def transfer_benefit(outcome: str | Column, transfer: float | Column, line: float) -> Column:
    """Fall of a household's shortfall when it gets ``transfer``."""
    y = F.col(outcome) if isinstance(outcome, str) else outcome
    t = transfer if isinstance(transfer, Column) else F.lit(float(transfer))
    return shortfall(y, line) - shortfall(y + t, line)


def binary_transfer(
    df: DataFrame,
    outcome: str,
    weight: str,
    line: float,
    transfers: Sequence[float],
    budgets: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """A fixed transfer to the households with the largest benefit until the budget is spent.

    The benefit min(transfer, shortfall) falls with the outcome, so the order is
    poorest first; equal outcomes are served together or not at all. One row per
    (group, transfer, budget).
    """
    by = list(by)
    if min(transfers) < 0:
        raise ValueError("a transfer must not be negative")
    summary = _summary(df, outcome, weight, line, by)
    curve, totals = _poor_curve(summary, outcome, by)
    grid = [(float(t), float(b)) for t in transfers for b in budgets]
    shares = join_groups(curve, totals, by).select(
        *by, outcome, "cum_w", "cum_wy", (F.col("cum_w") / F.col("all_w")).alias("share")
    )
    served = last_at_or_below(
        shares, outcome, "share", [b / t for t, b in grid], [outcome, "cum_w", "cum_wy"], by, totals
    )
    # the served whose transfer does not reach the line; they are all poor
    short = sums_below(
        summary, outcome, [line - t for t in transfers], {"w": F.sum("w"), "wy": F.sum("wy")}, by
    ).select(
        *by,
        _lookup(F.col("cut"), {line - t: t for t in transfers}).alias("transfer"),
        F.col("below_w").alias("short_w"),
        F.col("below_wy").alias("short_wy"),
    )
    pairs: dict[float, list[tuple[float, float]]] = {}
    for t, b in grid:
        pairs.setdefault(b / t, []).append((t, b))
    options = F.create_map(
        *[
            x
            for ratio, tb in pairs.items()
            for x in (
                F.lit(ratio),
                F.array(*[F.struct(F.lit(t).alias("t"), F.lit(b).alias("b")) for t, b in tb]),
            )
        ]
    )
    rows = served.withColumn("__tb", F.explode(options[F.col("threshold")])).select(
        *by, F.col("__tb.t").alias("transfer"), F.col("__tb.b").alias("budget"), outcome, "cum_w", "cum_wy",
        "all_w", "poor_w", "poor_wy",
    )
    out = join_groups(rows, short, [*by, "transfer"]).withColumns(_before(line))
    w, wy = F.coalesce("cum_w", F.lit(0.0)), F.coalesce("cum_wy", F.lit(0.0))
    # both are totals of a poorest-first prefix, so the shorter prefix is in both
    left = F.col("short_w") < w
    both_w = F.when(left, F.col("short_w")).otherwise(w)
    both_wy = F.when(left, F.col("short_wy")).otherwise(wy)
    t = F.col("transfer")
    gap_served = (line - t) * both_w - both_wy
    gap_unserved = line * (F.col("poor_w") - w) - (F.col("poor_wy") - wy)
    return out.select(
        *by,
        "transfer",
        "budget",
        "initial_poverty_rate",
        "initial_poverty_gap",
        ((gap_served + gap_unserved) / F.col("all_w")).alias("post_transfer_poverty_gap"),
        ((both_w + F.col("poor_w") - w) / F.col("all_w")).alias("post_transfer_poverty_rate"),
        (t * w / F.col("all_w")).alias("policy_cost_per_capita"),
    )


def best_transfer(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group and budget, the transfer size that leaves the smallest gap (smaller size on ties)."""
    cols = [c for c in results.columns if c not in [*by, "budget"]]
    order = F.struct("post_transfer_poverty_gap", "transfer")
    return (
        results.groupBy(*by, "budget")
        .agg(F.min_by(F.struct(*cols), order).alias("__b"))
        .select(*by, "budget", *[F.col(f"__b.{c}").alias(c) for c in cols])
    )


def ranked_transfer(
    df: DataFrame,
    outcome: str,
    weight: str,
    rank_by: str,
    line: float,
    transfer: float,
    budgets: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Proxy-means test: a fixed transfer in ascending ``rank_by`` until the budget is spent.

    ``rank_by`` is usually predicted consumption. Households with equal
    ``rank_by`` are served together or not at all.
    """
    by = list(by)
    df = named_groups(df, by)
    w, y = F.col(weight), F.col(outcome)
    poor0 = F.coalesce(F.sum(F.when(y < line, w)), F.lit(0.0))
    gap0 = F.coalesce(F.sum(shortfall(y, line) * w), F.lit(0.0))
    poor1 = F.coalesce(F.sum(F.when(y + transfer < line, w)), F.lit(0.0))
    gap1 = F.coalesce(F.sum(shortfall(y + transfer, line) * w), F.lit(0.0))
    parts = {"w": F.coalesce(F.sum(w), F.lit(0.0)), "p0": poor0, "g0": gap0, "p1": poor1, "g1": gap1}
    curve = running_totals(df.filter(w > 0), rank_by, parts, by)
    totals = df.groupBy(*by).agg(F.sum(w).alias("all_w"), poor0.alias("all_p0"), gap0.alias("all_g0"))
    priced = join_groups(curve, totals, by).select(
        *by, rank_by, *[f"cum_{p}" for p in parts], (F.col("cum_w") * float(transfer) / F.col("all_w")).alias("cost")
    )
    out = last_at_or_below(priced, rank_by, "cost", budgets, [*[f"cum_{p}" for p in parts], "cost"], by, totals)
    c = {p: F.coalesce(f"cum_{p}", F.lit(0.0)) for p in parts}
    n = F.col("all_w")
    return out.select(
        *by,
        F.col("threshold").alias("budget"),
        (F.col("all_p0") / n).alias("initial_poverty_rate"),
        (F.col("all_g0") / n).alias("initial_poverty_gap"),
        ((F.col("all_g0") - c["g0"] + c["g1"]) / n).alias("post_transfer_poverty_gap"),
        ((F.col("all_p0") - c["p0"] + c["p1"]) / n).alias("post_transfer_poverty_rate"),
        F.coalesce("cost", F.lit(0.0)).alias("policy_cost_per_capita"),
    )


def label_runs(results: DataFrame, **labels) -> DataFrame:
    """Add run labels (policy type, feature set, counts) as constant columns."""
    return results.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in labels.items()})


def subnational_table(results: DataFrame, population: str) -> DataFrame:
    """Totals, reductions and cost per unit of reduction; NULL where nothing was reduced."""
    n = F.col(population)
    out = results.withColumns(
        {
            "total_cost": F.col("policy_cost_per_capita") * n,
            "initial_poverty_count": F.col("initial_poverty_rate") * n,
            "post_transfer_poverty_count": F.col("post_transfer_poverty_rate") * n,
            "initial_total_poverty_gap": F.col("initial_poverty_gap") * n,
            "post_transfer_total_poverty_gap": F.col("post_transfer_poverty_gap") * n,
            "poverty_rate_reduction": F.col("initial_poverty_rate") - F.col("post_transfer_poverty_rate"),
            "poverty_gap_reduction": F.col("initial_poverty_gap") - F.col("post_transfer_poverty_gap"),
        }
    )
    out = out.withColumns(
        {
            "poverty_count_reduction": F.col("initial_poverty_count") - F.col("post_transfer_poverty_count"),
            "total_poverty_gap_reduction": F.col("initial_total_poverty_gap")
            - F.col("post_transfer_total_poverty_gap"),
        }
    )
    return out.withColumns(
        {
            "cost_per_poverty_count_reduction": F.try_divide("total_cost", "poverty_count_reduction"),
            "cost_per_total_poverty_gap_reduction": F.try_divide("total_cost", "total_poverty_gap_reduction"),
        }
    )


def annual_cost(cost_per_person_day: str | Column, population: float | Column, ppp_per_usd: float | Column) -> Column:
    """Daily PPP cost per person to nominal USD billions a year."""
    c = F.col(cost_per_person_day) if isinstance(cost_per_person_day, str) else cost_per_person_day
    n = population if isinstance(population, Column) else F.lit(float(population))
    p = ppp_per_usd if isinstance(ppp_per_usd, Column) else F.lit(float(ppp_per_usd))
    return c * n * F.lit(365.0) / p / F.lit(1e9)
