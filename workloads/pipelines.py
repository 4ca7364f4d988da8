"""Whole pipelines: country panel, survey tables, run comparison, model grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from welfarelens.operators import policy as P
from welfarelens.session import held_small
from welfarelens.plans import comparison as C, country_panel as N, predictors as M, survey as Y
from workloads.country_panel import _year_case
from workloads.policies import BUDGETS, _UBI, _interp_sql
from workloads.predictors import LEARN, area_sql, learner_table
from workloads.registry import query
from workloads.tables import (
    HH, LINE, SERIES, SURVEYS, YEARS, households, r6, rounded, series, surveys, table, wide, wide_sql, with_,
)


def _cpi(spark, sf):
    o = table(spark, sf, "orders")
    year = F.year("o_orderdate")
    key = F.col("o_custkey").alias("entity")
    cpi = o.groupBy(key).agg(
        *[F.avg(F.when(year == int(y), F.col("o_totalprice") / 1024)).alias(y) for y in YEARS]
    )
    ppp = o.groupBy(key).agg(
        *[F.max(F.when(year == int(y), F.col("o_totalprice") / 131072)).alias(y) for y in YEARS]
    )
    return cpi, ppp


def _panel(spark, sf):
    s = series(spark, sf)
    cpi, ppp = _cpi(spark, sf)
    customer = table(spark, sf, "customer")
    curated = customer.filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("entity"),
        (F.abs("c_acctbal") / 1024 + 1).alias("conversion_to_2017_ppp"),
        (F.abs("c_acctbal") / 2048 + 1).alias("conversion_to_2021_ppp"),
    )
    return N.compile_panel(
        N.PanelInputs(
            poverty={
                "2017": s,
                "2021": s.withColumns(
                    {"headcount": F.col("headcount") * 1.25, "poverty_gap": F.col("poverty_gap") * 1.25}
                ),
            },
            surveys=surveys(spark, sf).select("entity", "survey_year", "base_year"),
            cpi=cpi, ppp=ppp,
            at_survey={"population": (wide(spark, sf, "n"), 1.0)},
            latest={"aid": (wide(spark, sf, "mean_consumption"), 1.0)},
            overrides=[curated],
            households=households(spark, sf).select(
                F.col("village").alias("entity"), F.col("consumption").alias("outcome"), "weight"
            ),
        ),
        ("1997", "2000"),
    )


def _estimate(v: str) -> str:
    return f"""CASE WHEN has_exact THEN e_{v} WHEN yb IS NOT NULL AND ya IS NOT NULL THEN b_{v} + (x.survey_year - yb) / (ya - yb) * (a_{v} - b_{v}) ELSE coalesce(b_{v}, a_{v}) END"""


_LERP = (
    f"CASE WHEN base_year = floor(base_year) THEN {_year_case('floor(base_year)', 'c.')} "
    f"ELSE {_year_case('floor(base_year)', 'c.')} * (1 - (base_year - floor(base_year))) "
    f"+ {_year_case('floor(base_year) + 1', 'c.')} * (base_year - floor(base_year)) END"
)
_BY_YEAR = ", ".join(f'avg(o_totalprice / 1024) FILTER (year(o_orderdate) = {y}) AS "{y}"' for y in YEARS)
_PANEL = with_(HH, SERIES, SURVEYS, wide_sql("n", "wn")) + f""",
l AS (SELECT entity, arg_max(struct_pack(v := headcount), reporting_year).v AS h, count(headcount) AS nh, max(reporting_year) AS y,
  arg_max(poverty_gap, reporting_year) AS g, arg_max(mean_consumption, reporting_year) AS aid FROM series GROUP BY entity),
x AS (SELECT q.entity, survey_year, coalesce(bool_or(reporting_year = survey_year), false) AS has_exact,
  max(headcount) FILTER (reporting_year = survey_year) AS e_h, max(poverty_gap) FILTER (reporting_year = survey_year) AS e_g,
  max(reporting_year) FILTER (reporting_year < survey_year AND headcount IS NOT NULL) AS yb,
  arg_max(headcount, reporting_year) FILTER (reporting_year < survey_year AND headcount IS NOT NULL) AS b_h,
  arg_max(poverty_gap, reporting_year) FILTER (reporting_year < survey_year AND headcount IS NOT NULL) AS b_g,
  min(reporting_year) FILTER (reporting_year > survey_year AND headcount IS NOT NULL) AS ya,
  arg_min(headcount, reporting_year) FILTER (reporting_year > survey_year AND headcount IS NOT NULL) AS a_h,
  arg_min(poverty_gap, reporting_year) FILTER (reporting_year > survey_year AND headcount IS NOT NULL) AS a_g
  FROM surveys q LEFT JOIN series s ON q.entity = s.entity GROUP BY q.entity, survey_year),
c AS (SELECT o_custkey AS entity, {_BY_YEAR} FROM orders GROUP BY 1),
p AS (SELECT o_custkey AS entity, max(o_totalprice / 131072) FILTER (year(o_orderdate) = 1997) AS pa, max(o_totalprice / 131072) FILTER (year(o_orderdate) = 2000) AS pb FROM orders GROUP BY 1),
f AS (SELECT s.entity, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN abs(c_acctbal) / 1024 + 1 END, c."1997" / {_LERP} / pa) AS f17,
  coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN abs(c_acctbal) / 2048 + 1 END, c."2000" / {_LERP} / pb) AS f21
  FROM surveys s LEFT JOIN c ON s.entity = c.entity LEFT JOIN p ON s.entity = p.entity JOIN customer ON c_custkey = s.entity),
m AS (SELECT village AS entity,
  CASE WHEN max(f17 / f21) IS NOT NULL THEN coalesce(sum(weight) FILTER (consumption * (f17 / f21) < 2.15), 0) / sum(weight) END AS r17, sum(weight) FILTER (consumption < 3.0) AS r21w, sum(weight) AS w,
  coalesce(sum(greatest(3.0 - consumption, 0) * weight), 0) / (3.0 * sum(weight)) AS g21 FROM hh LEFT JOIN f ON f.entity = village GROUP BY village)
"""


@query(_PANEL + f"""SELECT s.entity, s.survey_year, round(CASE WHEN nh > 0 THEN h END, 6) AS poverty_rate_2017_most_recent,
  CASE WHEN nh > 0 THEN l.y END AS poverty_rate_2017_most_recent_year, round(g * 1.25, 6) AS poverty_gap_2021_most_recent,
  round({_estimate('h')}, 6) AS poverty_rate_2017_survey_year, round(1.25 * ({_estimate('g')}), 6) AS poverty_gap_2021_survey_year,
  CASE WHEN has_exact THEN 'exact year' WHEN yb IS NOT NULL AND ya IS NOT NULL THEN 'interpolated using ' || yb || ' and ' || ya
       WHEN coalesce(yb, ya) IS NOT NULL THEN 'from nearest year: ' || coalesce(yb, ya) ELSE 'no data available' END AS method_2017,
  {_year_case('s.survey_year', 'wn.')}::DOUBLE AS population, round(aid, 6) AS aid, l.y AS aid_year,
  round(f17, 6) AS conversion_to_2017_ppp, round(f21, 6) AS conversion_to_2021_ppp, round(f17 / f21, 6) AS ratio_2021_to_2017,
  round(r17, 6) AS survey_poverty_rate_2017, round(coalesce(r21w, CASE WHEN w IS NOT NULL THEN 0 END) / w, 6) AS survey_poverty_rate_2021, round(g21, 6) AS survey_poverty_gap_index_2021
FROM surveys s LEFT JOIN l ON s.entity = l.entity LEFT JOIN x ON s.entity = x.entity LEFT JOIN wn ON s.entity = wn.entity
LEFT JOIN f ON s.entity = f.entity LEFT JOIN m ON s.entity = m.entity""")
def country_panel(spark, sf):
    out = _panel(spark, sf).select(
        "entity", "survey_year", "poverty_rate_2017_most_recent", "poverty_rate_2017_most_recent_year",
        "poverty_gap_2021_most_recent", "poverty_rate_2017_survey_year", "poverty_gap_2021_survey_year", "method_2017",
        "population", "aid", "aid_year", "conversion_to_2017_ppp", "conversion_to_2021_ppp", "ratio_2021_to_2017",
        "survey_poverty_rate_2017", "survey_poverty_rate_2021", "survey_poverty_gap_index_2021",
    )
    exact = ("entity", "survey_year", "poverty_rate_2017_most_recent_year", "method_2017", "population", "aid_year")
    return rounded(out, *[c for c in out.columns if c not in exact])


@query(_PANEL + "SELECT s.entity, round(f21, 6) AS conversion_factor FROM surveys s LEFT JOIN f ON s.entity = f.entity WHERE s.survey_year IS NOT NULL")
def currency_table(spark, sf):
    return rounded(N.currency_table(_panel(spark, sf)), "conversion_factor")


@query("""
WITH g AS (SELECT c_nationkey AS entity, year(o_orderdate) AS y, sum(o_totalprice) AS gdp, avg(o_totalprice) AS cpi FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT max(cpi) FILTER (y = 2000) / max(cpi) FILTER (y = 1997) AS s FROM g WHERE entity = 3)
SELECT 'first_GDP_2000' AS indicator, round(max(gdp) FILTER (entity = 0 AND y = 2000) * max(s) / 1e9, 9) AS value FROM g, s
UNION ALL SELECT 'second_GDP_2000', round(max(gdp) FILTER (entity = 1 AND y = 2000) * max(s) / 1e9, 9) FROM g, s
UNION ALL SELECT 'conversion_factor_nominal_USD_' || y || '_to_2000', round(cpi / (SELECT cpi FROM g WHERE entity = 3 AND y = 2000), 9) FROM g WHERE entity = 3 AND y >= 1996""")
def secondary_indicators(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    year = F.year("o_orderdate")

    def by_year(agg):
        return joined.groupBy(F.col("c_nationkey").alias("entity")).agg(
            *[agg(F.when(year == int(y), F.col("o_totalprice"))).alias(y) for y in YEARS]
        )

    out = N.secondary_indicators(
        by_year(F.sum), by_year(F.avg), {"first": 0, "second": 1}, reference=3, first_year=1996, base_year=2000,
        price_year=1997,
    )
    return rounded(out, "value", digits=9)


@query(with_(HH) + """, x AS (SELECT CASE WHEN year < 1999 THEN 'learn' ELSE 'test' END AS part, * FROM hh)
SELECT part, count(*) AS rows, count(*) FILTER (area = '1-URGENT') AS urgent, count(*) FILTER (status = 'P') AS pending,
       count(*) FILTER (stratum = 'BUILDING') AS building, round(sum(consumption::FLOAT::DOUBLE), 4) AS consumption FROM x GROUP BY part""")
def survey_datasets(spark, sf):
    hh = households(spark, sf).select("hhid", "consumption", "weight", "hh_size", "hh_wgt", "district", "stratum", "area", "status", "year")
    described = [
        ("consumption", "numeric", False, False), ("weight", "numeric", False, False), ("hh_size", "numeric", False, False),
        ("district", "categorical", True, False), ("stratum", "categorical", True, True), ("area", "categorical", False, False),
        ("status", "categorical", False, False),
    ]
    meta = spark.createDataFrame(
        described, "variable_name string, data_type string, geographic_indicator boolean, geographic_indicator_coarser boolean"
    )
    d = Y.prepare_datasets(
        hh.filter("year < 1999").drop("year"), hh.filter("year >= 1999").drop("year"), meta, "consumption", "weight"
    )
    both = d.train.unionByName(d.validation).withColumn("part", F.lit("learn")).unionByName(
        d.test.withColumn("part", F.lit("test"))
    )
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("area_1-URGENT").cast("long").alias("urgent"),
        F.sum("status_P").cast("long").alias("pending"),
        F.sum("stratum_BUILDING").cast("long").alias("building"),
        r6(F.sum(F.col("consumption").cast("double")), 4).alias("consumption"),
    )


@query(with_(HH) + f""", b AS (SELECT unnest({BUDGETS}::DOUBLE[]) AS budget),
u AS (SELECT budget, sum(greatest(2.15 - consumption - budget, 0) * weight) / sum(weight) AS g, sum(CASE WHEN consumption < 2.15 - budget THEN weight ELSE 0 END) / sum(weight) AS r FROM hh, b GROUP BY budget),
i AS (SELECT sum(greatest(2.15 - consumption, 0) * weight) / sum(weight) AS g, sum(CASE WHEN consumption < 2.15 THEN weight ELSE 0 END) / sum(weight) AS r FROM hh)
SELECT 'ubi' AS policy_type, budget, 2 AS run, round(g, 6) AS post_transfer_poverty_gap, round(r, 6) AS post_transfer_poverty_rate FROM u
UNION ALL SELECT 'oracle_gap', budget, 2, round(greatest(i.g - budget, 0), 6), round(CASE WHEN budget >= i.g - 1e-12 THEN 0 ELSE i.r END, 6) FROM b, i""")
def run_comparison(spark, sf):
    hh = households(spark, sf).select("consumption", "weight")

    def runs(policy):
        first = policy(hh, "consumption", "weight", 3.0, BUDGETS).withColumn("run", F.lit(1))
        return first.unionByName(policy(hh, "consumption", "weight", LINE, BUDGETS).withColumn("run", F.lit(2)))

    out = C.collect_runs({"ubi": runs(P.uniform_transfer), "oracle_gap": runs(P.oracle_gap)})
    out = out.select("policy_type", "budget", "run", "post_transfer_poverty_gap", "post_transfer_poverty_rate")
    return rounded(out, "post_transfer_poverty_gap", "post_transfer_poverty_rate")


_TWO = f"""b AS (SELECT unnest({BUDGETS}::DOUBLE[]) AS budget),
i AS (SELECT sum(greatest(2.15 - consumption, 0) * weight) / sum(weight) AS g FROM hh),
runs AS (SELECT 'ubi' AS p, budget AS f, sum(greatest(2.15 - budget - consumption, 0) * weight) / sum(weight) AS x FROM hh, b GROUP BY budget
  UNION ALL SELECT 'oracle_gap', least(budget, g), greatest(g - budget, 0) FROM b, i)"""


@query(with_(HH, _TWO) + f""", m AS (SELECT min(x) AS top FROM (SELECT max(x) AS x FROM runs GROUP BY p)),
q AS (SELECT top * i / 39 AS q FROM m, range(40) r(i)),
c AS (SELECT * FROM {_interp_sql('runs', 'x', 'f', 'q', 'p')})
SELECT a.p AS policy_type, round(a.q, 6) AS post_transfer_poverty_gap, round(a.v / nullif(o.v, 0), 5) AS ratio
FROM c a JOIN c o ON a.q = o.q AND o.p = 'oracle_gap'
WHERE a.p <> 'oracle_gap' AND a.q <= (SELECT max(x) FROM runs WHERE p = 'oracle_gap' AND f > 0.1)""")
def oracle_cost_ratios(spark, sf):
    hh = households(spark, sf).select("consumption", "weight")
    runs = C.collect_runs(
        {
            "ubi": P.uniform_transfer(hh, "consumption", "weight", LINE, BUDGETS).withColumn("run", F.lit(1)),
            "oracle_gap": P.oracle_gap(hh, "consumption", "weight", LINE, BUDGETS).withColumn("run", F.lit(1)),
        }
    )
    out = C.compare_with_oracle(held_small(runs), "oracle_gap", "post_transfer_poverty_gap")
    return rounded(rounded(out, "post_transfer_poverty_gap"), "ratio", digits=5)


@query()
def model_grid(spark, sf):
    data = learner_table(spark, sf)
    specs = [
        M.ModelSpec("assets", ["assets", "hh_size"], "outcome"),
        M.ModelSpec("all", LEARN, "outcome", group="district"),
        M.ModelSpec("all", LEARN, "outcome", components=3),
        M.ModelSpec("all", LEARN, "outcome", components=3, alphas=[1e-3]),
    ]
    return M.model_grid(data, specs, "hhid", "weight", folds=3)


@query(area_sql(1e-4, ["assets", "hh_size"]))
def area_effects(spark, sf):
    data = learner_table(spark, sf)
    return rounded(M.area_effects(data, "district", ["assets", "hh_size"], "outcome", "hhid", "weight", folds=3), "coefficient")


_PARTS = """x AS (SELECT *, row_number() OVER (ORDER BY substr(md5('1234:' || hhid::VARCHAR), 1, 15), hhid::VARCHAR) AS r, count(*) OVER () AS n FROM hh WHERE year < 1999),
parts AS (SELECT CASE WHEN r <= floor(n * 0.8 + 0.5) THEN 'train' ELSE 'validation' END AS part, * EXCLUDE (r, n) FROM x UNION ALL SELECT 'test', * FROM hh WHERE year >= 1999),
names AS (SELECT unnest(['consumption', 'weight', 'hh_size']) AS c UNION SELECT 'stratum_' || stratum FROM hh UNION SELECT 'area_' || area FROM hh)"""


@query(with_(HH, _PARTS) + """
SELECT part, count(*) AS rows, sum(hh_size) AS people, count(*) FILTER (area = '1-URGENT') AS urgent, round(sum(consumption::FLOAT::DOUBLE), 4) AS consumption,
  (SELECT string_agg(c, ',' ORDER BY c) FROM names) AS columns, 'float' AS types FROM parts GROUP BY part""")
def survey_dataset_parts(spark, sf):
    """Who is in the training, validation and test part, which columns are left, and their types."""
    hh = households(spark, sf).select("hhid", "consumption", "weight", "hh_size", "hh_wgt", "district", "stratum", "area", "year")
    described = [("district", "categorical", True, False), ("stratum", "categorical", True, True), ("area", "categorical", False, False)]
    meta = spark.createDataFrame(
        described, "variable_name string, data_type string, geographic_indicator boolean, geographic_indicator_coarser boolean"
    )
    d = Y.prepare_datasets(
        hh.filter("year < 1999").drop("year"), hh.filter("year >= 1999").drop("year"), meta, "consumption", "weight"
    )
    out = None
    for name, part in (("train", d.train), ("validation", d.validation), ("test", d.test)):
        kinds = ",".join(sorted({f.dataType.simpleString() for f in part.schema.fields}))
        row = part.agg(
            F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("hh_size").cast("double")).alias("people"),
            F.sum("area_1-URGENT").cast("long").alias("urgent"), r6(F.sum(F.col("consumption").cast("double")), 4).alias("consumption"),
            F.lit(",".join(sorted(part.columns))).alias("columns"), F.lit(kinds).alias("types"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(with_(HH, _UBI) + """, n AS (SELECT sum(greatest(2.15 - consumption, 0) * weight) / sum(weight) AS g0, sum(greatest(1.65 - consumption, 0) * weight) / sum(weight) AS g1 FROM hh)
SELECT district AS features, round(initial_poverty_gap, 6) AS initial_poverty_gap, round(post_transfer_poverty_gap, 6) AS post_transfer_poverty_gap,
       round(g0, 6) AS national_initial_poverty_gap, round(g1, 6) AS national_post_transfer_poverty_gap FROM u, n WHERE budget = 0.5""")
def subnational_beside_national(spark, sf):
    hh = households(spark, sf)
    parts = P.uniform_transfer(hh, "consumption", "weight", LINE, [0.5], ["district"]).withColumnRenamed("district", "features")
    whole = P.label_runs(P.uniform_transfer(hh, "consumption", "weight", LINE, [0.5]), features="full_country")
    out = C.subnational_comparison(parts.unionByName(whole), "features", "full_country").select(
        "features", "initial_poverty_gap", "post_transfer_poverty_gap", "national_initial_poverty_gap",
        "national_post_transfer_poverty_gap",
    )
    return rounded(out, *[c for c in out.columns if c != "features"])
