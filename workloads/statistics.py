"""Weighted statistics on the household view."""

from __future__ import annotations

from pyspark.sql import functions as F

from welfarelens.operators import distribution as D, ordered as O, poverty as P
from workloads.registry import query
from workloads.tables import HH, LINE, households, r6, rounded, with_


@query(with_(HH) + """
SELECT district, round(sum(CASE WHEN consumption < 2.15 THEN weight ELSE 0 END) / sum(weight), 6) AS poverty_rate,
       round(sum(greatest(2.15 - consumption, 0) * weight) / sum(weight), 6) AS poverty_gap,
       round(sum(greatest(2.15 - consumption, 0) * weight) / (2.15 * sum(weight)), 6) AS poverty_gap_index,
       round(sum(consumption * weight) / sum(weight), 6) AS mean_outcome, count(*) AS households
FROM hh GROUP BY district""")
def poverty_rate_gap_by_group(spark, sf):
    out = P.poverty_table(households(spark, sf), "consumption", "weight", LINE, ["district"])
    return rounded(out, "poverty_rate", "poverty_gap", "poverty_gap_index", "mean_outcome")


@query(with_(HH) + """
SELECT round(avg(consumption), 6) AS mean, round(stddev_samp(consumption), 6) AS std, round(min(consumption), 6) AS min,
       round(max(consumption), 6) AS max, round(sum(consumption), 4) AS sum, count(consumption) AS count FROM hh""")
def outcome_summary(spark, sf):
    out = P.describe_outcome(households(spark, sf), "consumption")
    return rounded(rounded(out, "mean", "std", "min", "max"), "sum", digits=4)


@query(with_(HH) + """, g AS (
  SELECT status, sum(greatest(2.15 - consumption, 0) * weight) / sum(weight) AS gap FROM hh GROUP BY status)
SELECT status, round(gap, 6) AS gap, round(gap * 100 / 2.15, 6) AS gap_index_percent FROM g""")
def gap_to_index_percent(spark, sf):
    t = P.poverty_table(households(spark, sf), "consumption", "weight", LINE, ["status"])
    return t.select(
        "status", r6("poverty_gap").alias("gap"), r6(P.gap_to_index("poverty_gap", LINE)).alias("gap_index_percent")
    )


@query(with_(HH) + """
SELECT village AS entity,
  round(sum(CASE WHEN consumption * (0.8 + village % 5 / 10.0) < 2.15 THEN weight ELSE 0 END) / sum(weight), 6) AS poverty_rate_base17,
  round(sum(greatest(2.15 - consumption * (0.8 + village % 5 / 10.0), 0) * weight) / (2.15 * sum(weight)), 6) AS poverty_gap_index_base17,
  round(sum(CASE WHEN consumption < 3.0 THEN weight ELSE 0 END) / sum(weight), 6) AS poverty_rate_base21,
  round(sum(greatest(3.0 - consumption, 0) * weight) / (3.0 * sum(weight)), 6) AS poverty_gap_index_base21
FROM (SELECT *, 0 AS z FROM hh) GROUP BY village""".replace("0.8 + village % 5 / 10.0", "0.75::DOUBLE + (village % 5) / 8.0::DOUBLE"))
def survey_metrics_two_lines(spark, sf):
    hh = households(spark, sf).withColumn("factor", F.lit(0.75) + (F.col("village") % 5) / 8.0)
    out = P.survey_metrics(
        hh.withColumnRenamed("village", "entity"), "consumption", "weight", "entity",
        {"base17": (2.15, "factor"), "base21": (3.0, None)},
    )
    return rounded(out, *[c for c in out.columns if c != "entity"])


@query(with_(HH) + """
SELECT round(avg(consumption), 6) AS all_households, round(avg(consumption) FILTER (area IN ('1-URGENT', '2-HIGH')), 6) AS urban,
       round(avg(consumption) FILTER (NOT area IN ('1-URGENT', '2-HIGH')), 6) AS other FROM hh""")
def filtered_means(spark, sf):
    urban = F.col("area").isin("1-URGENT", "2-HIGH")
    out = P.subset_means(
        households(spark, sf), "consumption", {"all_households": F.lit(True), "urban": urban, "other": ~urban}
    )
    return rounded(out, *out.columns)


LINES = [0.5, 1.0, 2.15, 3.0, 3.65, 6.85]


@query(with_(HH) + f""", l AS (SELECT unnest({LINES}::DOUBLE[]) AS line)
SELECT stratum, line, round(sum(CASE WHEN consumption < line THEN weight ELSE 0 END) / sum(weight), 6) AS poverty_rate,
       round(sum(greatest(line - consumption, 0) * weight) / sum(weight), 6) AS poverty_gap
FROM hh, l GROUP BY stratum, line""")
def poverty_at_many_lines(spark, sf):
    out = P.poverty_at_lines(households(spark, sf), "consumption", "weight", LINES, ["stratum"])
    return rounded(out, "poverty_rate", "poverty_gap")


PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


def _quantile_sql(by: str) -> str:
    key, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    group = f"GROUP BY {key}consumption" if by else "GROUP BY consumption"
    return with_(HH) + f""", g AS (SELECT {key}consumption AS v, sum(weight) AS w FROM hh {group}),
c AS (SELECT {key}v, sum(w) OVER ({part}ORDER BY v) AS cw, sum(w) OVER ({part.strip() if part else ''}) AS tot,
             lead(v) OVER ({part}ORDER BY v) AS nxt FROM g),
p AS (SELECT unnest({PROBS}::DOUBLE[]) AS prob),
h AS (SELECT {key}prob, min(struct_pack(v := v, cw := cw, tot := tot, nxt := nxt)) AS s
      FROM c, p WHERE cw >= prob * tot - 1e-9 * tot GROUP BY {key}prob)
SELECT {key}prob, round(greatest(CASE WHEN abs(s.cw - prob * s.tot) <= 1e-9 * s.tot AND s.nxt IS NOT NULL
       THEN (s.v + s.nxt) / 2 ELSE s.v END, 0), 6) AS quantile FROM h"""


@query(_quantile_sql("district"))
def weighted_quantile_by_group(spark, sf):
    return rounded(
        D.weighted_quantile(households(spark, sf), "consumption", "weight", PROBS, ["district"]), "quantile"
    )


@query(_quantile_sql(""))
def weighted_quantile_global(spark, sf):
    return rounded(D.weighted_quantile(households(spark, sf), "consumption", "weight", PROBS), "quantile")


@query(with_(HH) + """
SELECT stratum, round(median(consumption), 6) AS median FROM hh GROUP BY stratum""")
def median_by_stratum(spark, sf):
    return rounded(D.median(households(spark, sf), "consumption", ["stratum"]), "median")


@query(with_(HH) + """, g AS (SELECT stratum, round(consumption, 2) AS v, sum(weight) AS w FROM hh GROUP BY ALL)
SELECT stratum, v, w, sum(w) OVER (PARTITION BY stratum ORDER BY v) AS cum_w FROM g""")
def running_weight(spark, sf):
    hh = households(spark, sf).withColumn("v", F.round("consumption", 2))
    return O.running_totals(hh, "v", {"w": F.sum("weight")}, ["stratum"])


@query(with_(HH) + """, c AS (SELECT round(consumption, 1) AS v, count(*) AS n FROM hh GROUP BY 1)
SELECT round(-sum(n / t * ln(n / t)), 6) AS entropy, round(ln(max(t)), 6) AS uniform_entropy, count(*) AS distinct_values
FROM c, (SELECT sum(n)::DOUBLE AS t FROM c)""")
def entropy_of_values(spark, sf):
    hh = households(spark, sf).withColumn("v", F.round("consumption", 1))
    return rounded(D.entropy(hh, "v"), "entropy", "uniform_entropy")


@query(with_(HH) + """, g AS (SELECT district, avg(consumption) AS m, count(*) AS n, sum(consumption) AS s FROM hh GROUP BY district),
o AS (SELECT avg(consumption) AS om, count(*) AS nn FROM hh)
SELECT round((SELECT sum((consumption - m) * (consumption - m)) FROM hh JOIN g USING (district)) / (nn - 1), 6) AS var_within,
       round((SELECT sum(n * (m - om) * (m - om)) FROM g, o) / (nn - 1), 6) AS var_between,
       round((SELECT var_samp(consumption) FROM hh), 6) AS var_total FROM o""")
def variance_decomposition(spark, sf):
    out = D.variance_decomposition(households(spark, sf), "consumption", "district")
    return rounded(out, *out.columns)


@query(with_(HH) + """, x AS (SELECT log10(consumption) AS x FROM hh WHERE consumption > 0),
e AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
SELECT least(100, floor((x - lo) / (hi - lo) * 100)::INT + 1) AS bin, count(*) AS rows FROM x, e GROUP BY 1""")
def log_histogram(spark, sf):
    return D.histogram(households(spark, sf), "consumption", 100, log_x=True)


@query(with_(HH) + """, s AS (SELECT avg(consumption) AS m1, stddev_samp(consumption) AS s1, avg(assets) AS m2, stddev_samp(assets) AS s2 FROM hh)
SELECT hhid, round((consumption - m1) / s1, 6) + 0.0 AS consumption, round((assets - m2) / s2, 6) + 0.0 AS assets, 0.0::DOUBLE AS constant
FROM hh, s""")
def column_standardize(spark, sf):
    hh = households(spark, sf).select("hhid", "consumption", "assets", F.lit(7.0).alias("constant"))
    return rounded(D.standardize(hh, ["consumption", "assets", "constant"]), "consumption", "assets")


@query(with_(HH) + """
SELECT floor(ln(consumption) / 0.25)::BIGINT AS bin, count(*) AS rows, round(avg(greatest(2.15 - consumption, 0)), 6) AS ev_transfer
FROM hh GROUP BY 1""")
def transfer_by_log_consumption(spark, sf):
    hh = households(spark, sf).withColumn("ev_transfer", P.shortfall("consumption", LINE))
    return rounded(D.binned_mean(hh, F.ln("consumption"), ["ev_transfer"], 0.25), "ev_transfer")
