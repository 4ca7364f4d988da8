"""Transfer policies over budget grids, cost curves and their comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from welfarelens.functions.learning import pinball_loss
from welfarelens.operators import curves as C, dedup as U, policy as P, regress as R
from welfarelens.session import held_small
from workloads.registry import query
from workloads.tables import HH, LINE, households, r6, rounded, table, with_

BUDGETS = [0.01, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8, 1.1, 1.4, 1.7]
TOLERANCES = [0.0, 0.02, 0.05, 0.1, 0.15, 0.2]
RESULTS = P.RESULT_COLUMNS

_BEFORE = """round(sum(CASE WHEN consumption < 2.15 THEN weight ELSE 0 END) / sum(weight), 6) AS initial_poverty_rate,
  round(sum(greatest(2.15 - consumption, 0) * weight) / sum(weight), 6) AS initial_poverty_gap"""

_UBI = f"""u AS (SELECT district, budget, {_BEFORE},
  round(sum(greatest(2.15 - consumption - budget, 0) * weight) / sum(weight), 6) AS post_transfer_poverty_gap,
  round(sum(CASE WHEN consumption < 2.15 - budget THEN weight ELSE 0 END) / sum(weight), 6) AS post_transfer_poverty_rate,
  budget AS policy_cost_per_capita
  FROM hh, (SELECT unnest({BUDGETS}::DOUBLE[]) AS budget) GROUP BY district, budget)"""


@query(with_(HH, _UBI) + "SELECT * FROM u")
def policy_ubi_grid(spark, sf):
    out = P.uniform_transfer(households(spark, sf), "consumption", "weight", LINE, BUDGETS, ["district"])
    return rounded(out, *RESULTS)


# running totals over the poor of each district, shared by the oracles
_CURVE = """v AS (SELECT district, consumption AS y, sum(weight) AS w FROM hh WHERE consumption < 2.15 GROUP BY ALL),
c AS (SELECT district, y, sum(w) OVER p AS cw, sum(w * y) OVER p AS cwy FROM v WINDOW p AS (PARTITION BY district ORDER BY y)),
t AS (SELECT district, sum(weight) AS n, coalesce(sum(weight) FILTER (consumption < 2.15), 0) AS pw,
      coalesce(sum(weight * consumption) FILTER (consumption < 2.15), 0) AS pwy FROM hh GROUP BY district)"""


def _oracle_gap_sql(on_data: bool) -> str:
    floor = "s.y" if on_data else "least(2.15, (budget * n + s.cwy) / s.cw)"
    spent = "(s.y * s.cw - s.cwy) / n" if on_data else "least(budget, gap)"
    return with_(HH, _CURVE) + f""", b AS (SELECT unnest({BUDGETS}::DOUBLE[]) AS budget),
h AS (SELECT t.district, budget, n, pw, (2.15 * pw - pwy) / n AS gap,
        max(struct_pack(y := y, cw := cw, cwy := cwy)) FILTER ((y * cw - cwy) / n <= budget) AS s
      FROM t JOIN c ON t.district = c.district, b GROUP BY ALL),
f AS (SELECT *, budget >= gap - 1e-12 AS paid, {floor} AS level, {spent} AS spent FROM h)
SELECT district, budget, round(CASE WHEN paid THEN 2.15 ELSE level END, 6) AS floor, round(pw / n, 6) AS initial_poverty_rate,
  round(gap, 6) AS initial_poverty_gap, round(CASE WHEN paid THEN 0 ELSE gap - spent END, 6) AS post_transfer_poverty_gap,
  round(CASE WHEN paid THEN 0 ELSE pw / n END, 6) AS post_transfer_poverty_rate,
  round(CASE WHEN paid THEN gap ELSE spent END, 6) AS policy_cost_per_capita FROM f"""


@query(_oracle_gap_sql(False))
def policy_oracle_gap(spark, sf):
    out = P.oracle_gap(households(spark, sf), "consumption", "weight", LINE, BUDGETS, ["district"])
    return rounded(out, "floor", *RESULTS)


@query(_oracle_gap_sql(True))
def policy_oracle_gap_on_data(spark, sf):
    out = P.oracle_gap(
        households(spark, sf), "consumption", "weight", LINE, BUDGETS, ["district"], floor_on_data=True
    )
    return rounded(out, "floor", *RESULTS)


@query(with_(HH, _CURVE) + f""", b AS (SELECT unnest({TOLERANCES}::DOUBLE[]) AS tolerance),
h AS (SELECT t.district, tolerance, n, pw, pwy,
        max(struct_pack(cw := cw, cwy := cwy)) FILTER (cw / n <= tolerance) AS s
      FROM t JOIN c ON t.district = c.district, b GROUP BY ALL),
f AS (SELECT *, coalesce(s.cw, 0) AS kw, coalesce(s.cwy, 0) AS kwy FROM h)
SELECT district, tolerance, round(pw / n, 6) AS initial_poverty_rate, round((2.15 * pw - pwy) / n, 6) AS initial_poverty_gap,
  round((2.15 * kw - kwy) / n, 6) AS post_transfer_poverty_gap, round(kw / n, 6) AS post_transfer_poverty_rate,
  round((2.15 * (pw - kw) - (pwy - kwy)) / n, 6) AS policy_cost_per_capita FROM f""")
def policy_oracle_rate(spark, sf):
    out = P.oracle_rate(households(spark, sf), "consumption", "weight", LINE, TOLERANCES, ["district"])
    return rounded(out, *RESULTS)


SIZES = [0.3, 0.75, 1.5, 2.15]
BINARY_BUDGETS = [0.05, 0.2, 0.5, 1.0]

_BINARY = with_(HH, _CURVE) + f""", g AS (SELECT unnest({SIZES}::DOUBLE[]) AS transfer),
b AS (SELECT unnest({BINARY_BUDGETS}::DOUBLE[]) AS budget),
h AS (SELECT t.district, transfer, budget, n, max(y) FILTER (cw / n <= budget / transfer) AS top
      FROM t JOIN c ON t.district = c.district, g, b GROUP BY ALL),
e AS (SELECT h.district, transfer, budget,
  sum(CASE WHEN consumption < 2.15 THEN weight ELSE 0 END) / max(n) AS initial_poverty_rate,
  sum(greatest(2.15 - consumption, 0) * weight) / max(n) AS initial_poverty_gap,
  sum(CASE WHEN consumption <= top THEN greatest(2.15 - transfer - consumption, 0) ELSE greatest(2.15 - consumption, 0) END * weight) / max(n) AS post_transfer_poverty_gap,
  sum(CASE WHEN consumption <= top THEN (consumption < 2.15 - transfer)::INT ELSE (consumption < 2.15)::INT END * weight) / max(n) AS post_transfer_poverty_rate,
  sum(CASE WHEN consumption <= top THEN transfer * weight ELSE 0 END) / max(n) AS policy_cost_per_capita
  FROM h JOIN hh ON h.district = hh.district GROUP BY ALL)"""


@query(_BINARY + f"SELECT district, transfer, budget, {', '.join(f'round({c}, 6) AS {c}' for c in RESULTS)} FROM e")
def policy_binary(spark, sf):
    out = P.binary_transfer(
        households(spark, sf), "consumption", "weight", LINE, SIZES, BINARY_BUDGETS, ["district"]
    )
    return rounded(out, *RESULTS)


@query(_BINARY + f""", k AS (SELECT *, row_number() OVER (PARTITION BY district, budget ORDER BY round(post_transfer_poverty_gap, 9), transfer) AS rn FROM e)
SELECT district, budget, transfer, {', '.join(f'round({c}, 6) AS {c}' for c in RESULTS)} FROM k WHERE rn = 1""")
def policy_binary_best_size(spark, sf):
    out = P.binary_transfer(
        households(spark, sf), "consumption", "weight", LINE, SIZES, BINARY_BUDGETS, ["district"]
    )
    out = rounded(out, "post_transfer_poverty_gap", digits=9)
    return rounded(P.best_transfer(out, ["district"]), *RESULTS)


@query(with_(HH) + f""", v AS (SELECT assets AS p, sum(weight) AS w FROM hh GROUP BY assets),
c AS (SELECT p, sum(w) OVER (ORDER BY p) * 1.5 / (SELECT sum(weight) FROM hh) AS cost FROM v),
b AS (SELECT budget, max(p) FILTER (cost <= budget) AS top FROM c, (SELECT unnest({BUDGETS}::DOUBLE[]) AS budget) GROUP BY budget)
SELECT budget, {_BEFORE},
  round(sum(greatest(2.15 - consumption - CASE WHEN assets <= top THEN 1.5 ELSE 0 END, 0) * weight) / sum(weight), 6) AS post_transfer_poverty_gap,
  round(sum(CASE WHEN consumption + CASE WHEN assets <= top THEN 1.5 ELSE 0 END < 2.15 THEN weight ELSE 0 END) / sum(weight), 6) AS post_transfer_poverty_rate,
  round(sum(CASE WHEN assets <= top THEN 1.5 * weight ELSE 0 END) / sum(weight), 6) AS policy_cost_per_capita
FROM hh, b GROUP BY budget""")
def policy_ranked_by_proxy(spark, sf):
    out = P.ranked_transfer(households(spark, sf), "consumption", "weight", "assets", LINE, 1.5, BUDGETS)
    return rounded(out, *RESULTS)


@query(with_(HH) + f""", x AS (SELECT *, CASE WHEN area = '1-URGENT' THEN 0.8 ELSE hh_size / 16 END AS t FROM hh)
SELECT stratum, {_BEFORE},
  round(sum(greatest(2.15 - (consumption + t), 0) * weight) / sum(weight), 6) AS post_transfer_poverty_gap,
  round(sum(CASE WHEN consumption + t < 2.15 THEN weight ELSE 0 END) / sum(weight), 6) AS post_transfer_poverty_rate,
  round(sum(weight * t) / sum(weight), 6) AS policy_cost_per_capita FROM x GROUP BY stratum""")
def transfer_evaluation(spark, sf):
    hh = households(spark, sf).withColumn(
        "t", F.when(F.col("area") == "1-URGENT", F.lit(0.8)).otherwise(F.col("hh_size") / 16)
    )
    return rounded(P.evaluate_transfer(hh, "consumption", "weight", "t", LINE, ["stratum"]), *RESULTS)


@query(with_(HH, _CURVE) + """, h AS (
  SELECT t.district, n, (2.15 * pw - pwy) / n AS gap, max(struct_pack(y := y, cw := cw, cwy := cwy)) FILTER ((y * cw - cwy) / n <= 0.2) AS s
  FROM t JOIN c ON t.district = c.district GROUP BY ALL),
f AS (SELECT district, CASE WHEN 0.2 >= gap - 1e-12 THEN 2.15 ELSE least(2.15, (0.2 * n + s.cwy) / s.cw) END AS floor FROM h)
SELECT hhid, round(consumption, 6) AS consumption, round(greatest(floor - consumption, 0), 6) AS ev_transfer,
       round(least(1.0, greatest(2.15 - consumption, 0)), 6) AS benefit
FROM hh JOIN f ON hh.district = f.district""")
def household_transfers(spark, sf):
    hh = households(spark, sf)
    floors = P.oracle_gap(hh, "consumption", "weight", LINE, [0.2], ["district"]).select("district", "floor")
    out = hh.join(floors, "district").select(
        "hhid", "consumption", P.oracle_gap_transfer("consumption", "floor").alias("ev_transfer"),
        P.transfer_benefit("consumption", 1.0, LINE).alias("benefit"),
    )
    return rounded(out, "consumption", "ev_transfer", "benefit")


# ---------------------------------------------------------------- runs and curves


def national_runs(spark, sf):
    """UBI and oracle results for the country as a whole, one labelled table.

    Like any result table it is written once and then read by the comparisons.
    """
    hh = households(spark, sf).select("consumption", "weight")
    ubi = P.uniform_transfer(hh, "consumption", "weight", LINE, BUDGETS)
    gap = P.oracle_gap(hh, "consumption", "weight", LINE, BUDGETS).drop("floor")
    rate = P.oracle_rate(hh, "consumption", "weight", LINE, TOLERANCES)
    return held_small(U.union_labelled({"ubi": ubi, "oracle_gap": gap, "oracle_rate": rate}, "policy_type"))


_RUNS = f"""v AS (SELECT consumption AS y, sum(weight) AS w FROM hh WHERE consumption < 2.15 GROUP BY 1),
c AS (SELECT y, sum(w) OVER p AS cw, sum(w * y) OVER p AS cwy FROM v WINDOW p AS (ORDER BY y)),
t AS (SELECT sum(weight) AS n, sum(weight) FILTER (consumption < 2.15) AS pw, sum(weight * consumption) FILTER (consumption < 2.15) AS pwy FROM hh),
ubi AS (SELECT budget, sum(CASE WHEN consumption < 2.15 THEN weight ELSE 0 END) / sum(weight) AS initial_poverty_rate,
  sum(greatest(2.15 - consumption, 0) * weight) / sum(weight) AS initial_poverty_gap,
  sum(greatest(2.15 - budget - consumption, 0) * weight) / sum(weight) AS post_transfer_poverty_gap,
  sum(CASE WHEN consumption < 2.15 - budget THEN weight ELSE 0 END) / sum(weight) AS post_transfer_poverty_rate,
  budget AS policy_cost_per_capita FROM hh, (SELECT unnest({BUDGETS}::DOUBLE[]) AS budget) GROUP BY budget),
og AS (SELECT budget, pw / n AS initial_poverty_rate, (2.15 * pw - pwy) / n AS initial_poverty_gap,
  greatest((2.15 * pw - pwy) / n - budget, 0) AS post_transfer_poverty_gap,
  CASE WHEN budget >= (2.15 * pw - pwy) / n - 1e-12 THEN 0 ELSE pw / n END AS post_transfer_poverty_rate,
  least(budget, (2.15 * pw - pwy) / n) AS policy_cost_per_capita FROM t, (SELECT unnest({BUDGETS}::DOUBLE[]) AS budget)),
ork AS (SELECT tolerance, n, pw, pwy, coalesce(max(cw) FILTER (cw / n <= tolerance), 0) AS kw, coalesce(max(cwy) FILTER (cw / n <= tolerance), 0) AS kwy
  FROM c, t, (SELECT unnest({TOLERANCES}::DOUBLE[]) AS tolerance) GROUP BY ALL),
runs AS (SELECT *, NULL AS tolerance, 'ubi' AS policy_type FROM ubi UNION ALL SELECT *, NULL, 'oracle_gap' FROM og
  UNION ALL SELECT NULL, pw / n, (2.15 * pw - pwy) / n, (2.15 * kw - kwy) / n, kw / n, (2.15 * (pw - kw) - (pwy - kwy)) / n, tolerance, 'oracle_rate' FROM ork)"""


@query(with_(HH, _RUNS) + f"""
SELECT policy_type, budget, tolerance, {', '.join(f'round({c}, 6) AS {c}' for c in RESULTS)} FROM runs""")
def policy_runs_labelled(spark, sf):
    return rounded(national_runs(spark, sf), *RESULTS)


def _interp_sql(curve: str, x: str, f: str, queries: str, by: str) -> str:
    """np.interp per group: rows (by, q, v)."""
    return f"""(SELECT k AS {by}, q, CASE WHEN lo IS NULL THEN hi.f WHEN hi IS NULL OR lo.x = q THEN lo.f
      ELSE lo.f + (hi.f - lo.f) / (hi.x - lo.x) * (q - lo.x) END AS v
    FROM (SELECT {by} AS k, q, max(struct_pack(x := {x}, f := {f})) FILTER ({x} <= q) AS lo,
                 min(struct_pack(x := {x}, f := {f})) FILTER ({x} >= q) AS hi
          FROM {curve}, {queries} GROUP BY {by}, q))"""


@query(with_(HH, _RUNS) + f""", m AS (SELECT min(x) AS top FROM (SELECT max(post_transfer_poverty_gap) AS x FROM runs GROUP BY policy_type)),
q AS (SELECT top * i / 39 AS q FROM m, range(40) r(i)),
i AS (SELECT * FROM {_interp_sql('runs', 'post_transfer_poverty_gap', 'policy_cost_per_capita', 'q', 'policy_type')})
SELECT a.policy_type, round(a.q, 6) AS post_transfer_poverty_gap, round(a.v / nullif(b.v, 0), 5) AS ratio
FROM i a JOIN i b ON a.q = b.q AND b.policy_type = 'oracle_gap' WHERE a.policy_type <> 'oracle_gap'""")
def curve_interp_ratio(spark, sf):
    out = C.cost_ratios(
        national_runs(spark, sf), "policy_type", "oracle_gap", "policy_cost_per_capita", "post_transfer_poverty_gap"
    )
    return rounded(rounded(out, "post_transfer_poverty_gap"), "ratio", digits=5)


@query(with_(HH, _UBI) + f""", p AS (SELECT district, post_transfer_poverty_rate AS x, policy_cost_per_capita AS f FROM u
  UNION ALL SELECT district, max(initial_poverty_rate), 0.0 FROM u GROUP BY district),
i AS (SELECT * FROM {_interp_sql('p', 'x', 'f', '(SELECT 0.1::DOUBLE AS q)', 'district')})
SELECT district, q AS target, round(v, 6) AS cost_at_target FROM i""")
def cost_to_target(spark, sf):
    runs = P.uniform_transfer(households(spark, sf), "consumption", "weight", LINE, BUDGETS, ["district"])
    out = C.cost_to_target(
        rounded(runs, *RESULTS), "post_transfer_poverty_rate", "initial_poverty_rate", "policy_cost_per_capita", 0.1,
        ["district"],
    )
    return rounded(out, "cost_at_target")


@query(with_(HH, _RUNS) + f""", r AS (SELECT * FROM {_interp_sql('runs', 'post_transfer_poverty_rate', 'policy_cost_per_capita', '(SELECT 0.15::DOUBLE AS q)', 'policy_type')}),
g AS (SELECT * FROM {_interp_sql('runs', 'post_transfer_poverty_gap', 'policy_cost_per_capita', '(SELECT 0.05::DOUBLE AS q)', 'policy_type')})
SELECT r.policy_type, round(r.v, 6) AS rate_cost, round(g.v, 6) AS gap_cost, 0.05::DOUBLE AS gap_target FROM r JOIN g ON r.policy_type = g.policy_type""")
def method_cost_table(spark, sf):
    out = C.cost_table(
        national_runs(spark, sf), "post_transfer_poverty_rate", "post_transfer_poverty_gap", "policy_cost_per_capita",
        0.15, 0.05, ["policy_type"],
    )
    return rounded(out, "rate_cost", "gap_cost")


@query(with_(HH, _RUNS) + f""", g AS (SELECT * FROM {_interp_sql('runs', 'post_transfer_poverty_gap', 'policy_cost_per_capita', '(SELECT 0.05::DOUBLE AS q)', 'policy_type')})
SELECT round(max(v) FILTER (policy_type = 'ubi') / max(v) FILTER (policy_type = 'oracle_gap'), 6) AS ubi_over_oracle_gap,
       round(max(v) FILTER (policy_type = 'oracle_rate') / max(v) FILTER (policy_type = 'oracle_gap'), 6) AS rate_over_gap FROM g""")
def named_cost_ratios(spark, sf):
    costs = C.interpolate(
        national_runs(spark, sf), "post_transfer_poverty_gap", "policy_cost_per_capita", [0.05], ["policy_type"]
    )
    out = C.named_ratios(
        costs, "policy_type", "policy_cost_per_capita",
        {"ubi_over_oracle_gap": ("ubi", "oracle_gap"), "rate_over_gap": ("oracle_rate", "oracle_gap")},
    )
    return rounded(out, *out.columns)


@query(with_(HH, _RUNS) + """
SELECT policy_type, round(post_transfer_poverty_gap, 6) AS post_transfer_poverty_gap, round(policy_cost_per_capita, 6) AS policy_cost_per_capita
FROM runs WHERE post_transfer_poverty_gap <= (SELECT max(post_transfer_poverty_gap) FROM runs WHERE policy_type = 'oracle_gap' AND policy_cost_per_capita > 0.1)""")
def runs_within_oracle_range(spark, sf):
    out = C.within_oracle_range(
        national_runs(spark, sf), "policy_type", "oracle_gap", "post_transfer_poverty_gap", "policy_cost_per_capita"
    ).select("policy_type", "post_transfer_poverty_gap", "policy_cost_per_capita")
    return rounded(out, "post_transfer_poverty_gap", "policy_cost_per_capita")


@query(with_(HH, _UBI) + """, p AS (SELECT district, sum(weight) AS pop FROM hh GROUP BY district),
x AS (SELECT u.*, pop FROM u JOIN p ON u.district = p.district WHERE budget = 0.5),
y AS (SELECT district, round(pop, 3) AS weight_adjusted_population, policy_cost_per_capita * pop AS tc, (initial_poverty_rate - post_transfer_poverty_rate) * pop AS cr,
  (initial_poverty_gap - post_transfer_poverty_gap) * pop AS gr, initial_poverty_rate - post_transfer_poverty_rate AS rr FROM x)
SELECT district, weight_adjusted_population, round(tc, 3) AS total_cost, round(cr, 3) AS poverty_count_reduction, round(gr, 3) AS total_poverty_gap_reduction,
  round(rr, 6) AS poverty_rate_reduction, round(tc / nullif(cr, 0), 5) AS cost_per_poverty_count_reduction,
  round(tc / nullif(gr, 0), 5) AS cost_per_total_poverty_gap_reduction,
  round(tc * 365 / 3.0185 / 1e9, 9) AS annual_usd_billion FROM y""")
def subnational_cost_table(spark, sf):
    hh = households(spark, sf)
    runs = rounded(P.uniform_transfer(hh, "consumption", "weight", LINE, [0.5], ["district"]), *RESULTS)
    population = hh.groupBy("district").agg(F.sum("weight").alias("weight_adjusted_population"))
    out = P.subnational_table(runs.join(population, "district"), "weight_adjusted_population")
    out = out.withColumn(
        "annual_usd_billion",
        F.round(P.annual_cost("policy_cost_per_capita", F.col("weight_adjusted_population"), 3.0185), 9),
    ).select(
        "district", "weight_adjusted_population", "total_cost", "poverty_count_reduction", "total_poverty_gap_reduction",
        "poverty_rate_reduction", "cost_per_poverty_count_reduction", "cost_per_total_poverty_gap_reduction",
        "annual_usd_billion",
    )
    out = rounded(out, "weight_adjusted_population", "total_cost", "poverty_count_reduction", "total_poverty_gap_reduction", digits=3)
    out = rounded(out, "poverty_rate_reduction")
    return rounded(out, "cost_per_poverty_count_reduction", "cost_per_total_poverty_gap_reduction", digits=5)


@query("""
WITH t AS (SELECT l_suppkey AS trial, l_linenumber AS n_layers, l_quantity AS n_hidden_units, l_tax AS lr, l_returnflag AS policy, l_extendedprice / 1024 AS loss FROM lineitem),
a AS (SELECT policy, n_layers, n_hidden_units, lr, avg(loss) AS m FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY m, n_layers, n_hidden_units, lr) AS rn FROM a)
SELECT policy, n_layers, n_hidden_units, lr, round(m, 6) AS mean_loss FROM r WHERE rn = 1""")
def pick_hyperparameters(spark, sf):
    t = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("n_layers"), F.col("l_quantity").alias("n_hidden_units"), F.col("l_tax").alias("lr"),
        F.col("l_returnflag").alias("policy"), (F.col("l_extendedprice") / 1024).alias("loss"),
    )
    out = C.pick_hyperparameters(t, ["n_layers", "n_hidden_units", "lr"], "loss", ["policy"])
    return rounded(out, "mean_loss")


@query("""
WITH a AS (SELECT l_linenumber, l_tax, avg(l_extendedprice / 1024) AS m FROM lineitem GROUP BY ALL),
best AS (SELECT arg_min(l_linenumber, m) AS n_layers, arg_min(l_tax, m) AS lr FROM a)
SELECT 'lr' AS parameter, lr::DOUBLE AS tuned, 0.001::DOUBLE AS "default" FROM best
UNION ALL SELECT 'n_layers', n_layers, 3 FROM best UNION ALL SELECT 'n_hidden_units', NULL, 256""")
def tuned_against_default(spark, sf):
    t = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("double").alias("n_layers"), F.col("l_tax").alias("lr"),
        (F.col("l_extendedprice") / 1024).alias("loss"),
    )
    tuned = C.pick_hyperparameters(t, ["n_layers", "lr"], "loss").unpivot([], ["n_layers", "lr"], "parameter", "value")
    default = spark.createDataFrame(
        [("n_layers", 3.0), ("n_hidden_units", 256.0), ("lr", 0.001)], "parameter string, value double"
    )
    return C.compare_settings(tuned, default)


@query(with_(HH, _UBI) + """, r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY policy_cost_per_capita, budget) AS rn
  FROM u WHERE post_transfer_poverty_rate <= 0.15)
SELECT district, budget, policy_cost_per_capita FROM r WHERE rn = 1""")
def cheapest_under_bound(spark, sf):
    runs = rounded(
        P.uniform_transfer(households(spark, sf), "consumption", "weight", LINE, BUDGETS, ["district"]), *RESULTS
    )
    return C.cheapest_under_bound(
        runs, "post_transfer_poverty_rate", 0.15, "policy_cost_per_capita", "budget", ["district"]
    )


@query("""
WITH r AS (SELECT CASE l_returnflag WHEN 'A' THEN 'unconditional' ELSE 'discrete' END AS method, l_linenumber AS d, l_quantity AS nclass,
  min(l_extendedprice) AS policy_cost FROM lineitem GROUP BY ALL)
SELECT r.d, nclass, policy_cost, reference_cost FROM r
LEFT JOIN (SELECT d, min(policy_cost) AS reference_cost FROM r WHERE method = 'unconditional' GROUP BY d) x ON r.d = x.d WHERE method = 'discrete'""")
def cost_by_number_of_classes(spark, sf):
    method = F.when(F.col("l_returnflag") == "A", F.lit("unconditional")).otherwise(F.lit("discrete"))
    runs = table(spark, sf, "lineitem").groupBy(
        method.alias("method"), F.col("l_linenumber").alias("d"), F.col("l_quantity").alias("nclass")
    ).agg(F.min("l_extendedprice").alias("policy_cost"))
    return C.cost_by_classes(runs, "discrete", "unconditional")


# ---------------------------------------------------------------- estimated quantiles


@query(with_(HH) + """, m AS (SELECT stratum, avg(consumption) AS m FROM hh GROUP BY stratum),
e AS (SELECT stratum, tau, m * 2 * tau AS est FROM m, (SELECT unnest([0.1, 0.2, 0.3, 0.4]::DOUBLE[]) AS tau))
SELECT status, tau AS quantile, round(avg((consumption < est)::INT), 6) AS actual_below_estimated
FROM hh JOIN e ON hh.stratum = e.stratum GROUP BY status, tau""")
def quantile_calibration(spark, sf):
    hh = households(spark, sf)
    taus = F.explode(F.array(*[F.lit(t) for t in (0.1, 0.2, 0.3, 0.4)]))
    est = hh.groupBy("stratum").agg(F.avg("consumption").alias("m")).withColumn("quantile", taus)
    est = est.select("stratum", "quantile", (F.col("m") * 2 * F.col("quantile")).alias("estimate"))
    out = R.quantile_calibration(hh, est, "consumption", "stratum", ["status"])
    return rounded(out, "actual_below_estimated")


@query(with_(HH) + """, e AS (SELECT stratum, avg(consumption) * 0.5 AS q FROM hh GROUP BY stratum)
SELECT hh.stratum, round(sum(weight * (0.2 * greatest(consumption - q, 0) + 0.8 * greatest(q - consumption, 0))) / sum(weight), 6) AS pinball_loss
FROM hh JOIN e ON hh.stratum = e.stratum GROUP BY hh.stratum""")
def mean_pinball_loss(spark, sf):
    hh = households(spark, sf)
    est = hh.groupBy("stratum").agg((F.avg("consumption") * 0.5).alias("q"))
    return rounded(R.mean_pinball_loss(hh.join(est, "stratum"), "consumption", "q", 0.2, "weight", ["stratum"]), "pinball_loss")


@query(with_(HH) + """, e AS (SELECT stratum, avg(consumption) * f AS q, f FROM hh, (SELECT unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS f) GROUP BY stratum, f),
l AS (SELECT f, sum(weight * (0.2 * greatest(consumption - q, 0) + 0.8 * greatest(q - consumption, 0))) / sum(weight) AS loss FROM hh JOIN e ON hh.stratum = e.stratum GROUP BY f)
SELECT arg_min(f, loss) AS factor, round(min(loss), 6) AS pinball_loss FROM l""")
def best_estimate_by_pinball_loss(spark, sf):
    hh = households(spark, sf)
    factors = [0.25, 0.5, 0.75, 1.0]
    est = hh.groupBy("stratum").agg(F.avg("consumption").alias("m"))
    w = F.col("weight")
    row = hh.join(est, "stratum").agg(
        *[
            (F.sum(w * pinball_loss("consumption", F.col("m") * f, 0.2)) / F.sum(w)).alias(f"l{i}")
            for i, f in enumerate(factors)
        ]
    )
    best = F.array_min(
        F.array(*[F.struct(F.col(f"l{i}").alias("loss"), F.lit(f).alias("factor")) for i, f in enumerate(factors)])
    )
    return row.select(best.alias("b")).select("b.factor", r6("b.loss").alias("pinball_loss"))
