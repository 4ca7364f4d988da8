"""Entity by year series: latest values, lookups, estimates, filling, conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from welfarelens.functions import money as M
from welfarelens.operators import panel as P
from workloads.registry import query
from workloads.tables import (
    HH, LINE, PRICES, SERIES, SURVEYS, YEARS, households, prices, prices_wide, prices_wide_sql, r6, rounded, series,
    surveys, table, wide, wide_sql, with_,
)


def _year_case(year: str, source: str = "") -> str:
    return "CASE " + " ".join(f'WHEN {year} = {y} THEN {source}"{y}"' for y in YEARS) + " END"


@query(with_(SERIES) + """
SELECT entity,
  CASE WHEN count(headcount) > 0 THEN round(arg_max(struct_pack(v := headcount), reporting_year).v, 6) END AS latest_headcount,
  CASE WHEN count(headcount) > 0 THEN max(reporting_year) END AS latest_headcount_year,
  round(arg_max(struct_pack(v := poverty_gap), reporting_year).v, 6) AS latest_poverty_gap,
  max(reporting_year) AS latest_poverty_gap_year
FROM series GROUP BY entity""")
def latest_row_per_entity(spark, sf):
    out = P.latest_row(series(spark, sf), "entity", "reporting_year", ["headcount", "poverty_gap"])
    return rounded(out, "latest_headcount", "latest_poverty_gap")


@query(with_(SERIES, wide_sql()) + """, l AS (
  SELECT entity, max(reporting_year) FILTER (headcount IS NOT NULL) AS y, arg_max(headcount, reporting_year) FILTER (headcount IS NOT NULL) AS v
  FROM series GROUP BY entity)
SELECT entity, round(v / 1000, 9) AS recent, y AS recent_year FROM l""")
def latest_non_null_per_entity(spark, sf):
    out = P.latest_non_null(wide(spark, sf), "recent", scale=1e-3)
    return out.select("entity", r6("recent", 9).alias("recent"), "recent_year")


@query(with_(SERIES, wide_sql()) + """
SELECT entity, year::INT AS year, round(headcount, 6) AS headcount
FROM wide UNPIVOT INCLUDE NULLS (headcount FOR year IN ("1995", "1996", "1997", "1998", "1999", "2000", "2001"))""")
def years_to_rows(spark, sf):
    return rounded(P.to_long(wide(spark, sf), ["entity"], "headcount"), "headcount")


@query(with_(SERIES, SURVEYS) + """, x AS (
  SELECT q.entity, survey_year AS t, bool_or(reporting_year = survey_year) AS has_exact,
    max(headcount) FILTER (reporting_year = survey_year) AS eh, max(poverty_gap) FILTER (reporting_year = survey_year) AS eg,
    max(reporting_year) FILTER (reporting_year < survey_year AND headcount IS NOT NULL) AS yb,
    arg_max(headcount, reporting_year) FILTER (reporting_year < survey_year AND headcount IS NOT NULL) AS hb,
    arg_max(poverty_gap, reporting_year) FILTER (reporting_year < survey_year AND headcount IS NOT NULL) AS gb,
    min(reporting_year) FILTER (reporting_year > survey_year AND headcount IS NOT NULL) AS ya,
    arg_min(headcount, reporting_year) FILTER (reporting_year > survey_year AND headcount IS NOT NULL) AS ha,
    arg_min(poverty_gap, reporting_year) FILTER (reporting_year > survey_year AND headcount IS NOT NULL) AS ga
  FROM surveys q LEFT JOIN series s ON q.entity = s.entity GROUP BY q.entity, survey_year)
SELECT entity, t AS survey_year,
  round(CASE WHEN has_exact THEN eh WHEN yb IS NOT NULL AND ya IS NOT NULL THEN hb + (t - yb) / (ya - yb) * (ha - hb)
        ELSE coalesce(hb, ha) END, 6) AS headcount,
  round(CASE WHEN has_exact THEN eg WHEN yb IS NOT NULL AND ya IS NOT NULL THEN gb + (t - yb) / (ya - yb) * (ga - gb)
        ELSE coalesce(gb, ga) END, 6) AS poverty_gap,
  CASE WHEN has_exact THEN 'exact year'
       WHEN yb IS NOT NULL AND ya IS NOT NULL THEN 'interpolated using ' || yb || ' and ' || ya
       WHEN coalesce(yb, ya) IS NOT NULL THEN 'from nearest year: ' || coalesce(yb, ya)
       ELSE 'no data available' END AS method
FROM x""")
def year_interpolation(spark, sf):
    q = surveys(spark, sf).select("entity", "survey_year")
    out = P.estimate_at_year(
        q, "entity", "survey_year", series(spark, sf), "entity", "reporting_year", ["headcount", "poverty_gap"]
    )
    return rounded(out, "headcount", "poverty_gap")


@query(with_(SERIES, SURVEYS, wide_sql("mean_consumption")) + f"""
SELECT s.entity, survey_year, round({_year_case('survey_year', 'wide.')} * 2, 6) AS value_survey_year
FROM surveys s LEFT JOIN wide ON s.entity = wide.entity""")
def year_column_lookup(spark, sf):
    out = P.lookup_year(
        surveys(spark, sf).select("entity", "survey_year"), "entity", "survey_year",
        wide(spark, sf, "mean_consumption"), "entity", "value_survey_year", 2.0,
    )
    return rounded(out, "value_survey_year")


@query(with_(SERIES, wide_sql(), SURVEYS) + """, other AS (
  SELECT entity, avg(mean_consumption) AS a, max(poverty_gap) AS b FROM series WHERE reporting_year <= 1998 GROUP BY entity),
fix1 AS (SELECT c_custkey AS entity, c_acctbal / 1000 AS v FROM customer WHERE c_mktsegment = 'BUILDING'),
fix2 AS (SELECT c_custkey AS entity, c_acctbal / 500 AS v FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)
SELECT w.entity, round(coalesce(fix2.v, fix1.v, "1997", o.a), 6) AS factor_2017, round(coalesce("2001", o.b), 6) AS factor_2021,
  round(coalesce(fix2.v, fix1.v, "1997", o.a) / nullif(coalesce("2001", o.b), 0), 6) AS ratio
FROM wide w LEFT JOIN other o ON w.entity = o.entity LEFT JOIN fix1 ON w.entity = fix1.entity LEFT JOIN fix2 ON w.entity = fix2.entity""")
def impute_then_override(spark, sf):
    base = wide(spark, sf).select("entity", F.col("1997").alias("factor_2017"), F.col("2001").alias("factor_2021"))
    other = series(spark, sf).filter("reporting_year <= 1998").groupBy("entity").agg(
        F.avg("mean_consumption").alias("a"), F.max("poverty_gap").alias("b")
    )
    cust = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    fix1 = cust.select(F.col("c_custkey").alias("entity"), (F.col("c_acctbal") / 1000).alias("v"))
    fix2 = cust.filter("c_acctbal > 5000").select(
        F.col("c_custkey").alias("entity"), (F.col("c_acctbal") / 500).alias("v")
    )
    out = P.impute_from(base, other, "entity", {"factor_2017": "a", "factor_2021": "b"})
    out = P.override_from(out, fix1, "entity", {"factor_2017": "v"})
    out = P.override_from(out, fix2, "entity", {"factor_2017": "v"})
    out = out.withColumn("ratio", F.try_divide("factor_2017", "factor_2021"))
    return rounded(out, "factor_2017", "factor_2021", "ratio")


@query(with_(PRICES) + """
SELECT n AS entity, 'rate' AS series, 'ppp' AS base, s AS from_year, t AS to_year,
       round(a.rate / nullif(a.ppp, 0) * b.ppp, 6) AS estimate
FROM (SELECT n_nationkey AS n, 1995 + n_nationkey % 3 AS s, 2000 AS t FROM nation)
LEFT JOIN prices a ON a.nation = n AND a.year = s LEFT JOIN prices b ON b.nation = n AND b.year = t""")
def ratio_extrapolation(spark, sf):
    long = prices(spark, sf).unpivot(["nation", "year"], ["rate", "ppp"], "name", "value")
    rules = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("entity"), F.lit("rate").alias("series"), F.lit("ppp").alias("base"),
        (1995 + F.col("n_nationkey") % 3).alias("from_year"), F.lit(2000).alias("to_year"),
    )
    return rounded(P.ratio_extrapolation(long, "nation", "name", "year", "value", rules), "estimate")


_LERP = (
    f"CASE WHEN base_year = floor(base_year) THEN {_year_case('floor(base_year)', 'c.')} "
    f"ELSE {_year_case('floor(base_year)', 'c.')} * (1 - (base_year - floor(base_year))) "
    f"+ {_year_case('floor(base_year) + 1', 'c.')} * (base_year - floor(base_year)) END"
)


@query(with_(PRICES, SURVEYS, prices_wide_sql("cpi", "c"), prices_wide_sql("ppp", "p")) + f""", x AS (
  SELECT s.entity, {_LERP} AS cpi_base, c."1997" AS c17, c."2000" AS c21, p."1997" AS p17, p."2000" AS p21
  FROM surveys s LEFT JOIN c ON s.nation = c.nation LEFT JOIN p ON s.nation = p.nation)
SELECT entity, round(cpi_base, 6) AS cpi_base, round(c17 / cpi_base / p17, 6) AS conversion_to_2017_ppp,
       round(c21 / cpi_base / p21, 6) AS conversion_to_2021_ppp,
       round((c17 / cpi_base / p17) / (c21 / cpi_base / p21), 6) AS ratio_2021_to_2017 FROM x""")
def ppp_conversion(spark, sf):
    cpi = prices_wide(spark, sf, "cpi").withColumnRenamed("nation", "cn")
    ppp = prices_wide(spark, sf, "ppp").select(
        F.col("nation").alias("pn"), F.col("1997").alias("p17"), F.col("2000").alias("p21")
    )
    s = surveys(spark, sf)
    joined = s.join(cpi, s.nation == F.col("cn"), "left").join(ppp, s.nation == F.col("pn"), "left")
    joined = joined.withColumn("cpi_base", P.value_at_fractional_year("base_year", YEARS))
    out = joined.select(
        "entity", "cpi_base",
        *[c.alias(n) for n, c in M.conversion_factors("1997", "2000", "cpi_base", "p17", "p21").items()],
    )
    return rounded(out, *[c for c in out.columns if c != "entity"])


@query(with_(PRICES) + """, w AS (SELECT year, sum(cpi * population) / sum(population) AS v FROM prices GROUP BY year),
sp AS (SELECT unnest(range((SELECT min(year) FROM prices), 2002)) AS year)
SELECT 'conversion_factor_nominal_USD_' || sp.year || '_to_1999' AS indicator,
       round(v / (SELECT v FROM w WHERE year = 1999), 6) AS value FROM sp LEFT JOIN w ON sp.year = w.year""")
def index_to_base_year(spark, sf):
    p = prices(spark, sf)
    world = p.groupBy("year").agg((F.sum(F.col("cpi") * F.col("population")) / F.sum("population")).alias("value"))
    spine = P.year_spine(p, "year", 2001).join(world, "year", "left")
    out = P.index_to_base_year(spine, "year", "value", 1999)
    return rounded(out.select(M.year_label("year", 1999).alias("indicator"), "value"), "value")


@query(with_(PRICES) + """
SELECT nation, year, round(cpi / b, 6) AS cpi FROM prices JOIN (SELECT nation AS k, cpi AS b FROM prices WHERE year = 1999) ON nation = k""")
def index_per_entity(spark, sf):
    out = P.index_to_base_year(prices(spark, sf).select("nation", "year", "cpi"), "year", "cpi", 1999, ["nation"])
    return rounded(out, "cpi")


@query(with_(SERIES, wide_sql("mean_consumption")) + """, donors AS (
  SELECT c_custkey AS target, c_custkey - 1 AS donor FROM customer WHERE c_acctbal < 0)
SELECT w.entity, round(CASE WHEN target IS NULL THEN w."1997" ELSE d."1997" END, 6) AS rate_2017,
       round(CASE WHEN target IS NULL THEN w."2001" ELSE d."2001" END, 6) AS rate_2021
FROM wide w LEFT JOIN donors ON w.entity = target LEFT JOIN wide d ON d.entity = donor""")
def donor_copy(spark, sf):
    base = wide(spark, sf, "mean_consumption").select(
        "entity", F.col("1997").alias("rate_2017"), F.col("2001").alias("rate_2021")
    )
    donors = table(spark, sf, "customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias("target"), (F.col("c_custkey") - 1).alias("donor")
    )
    return rounded(P.donor_copy(base, "entity", donors, ["rate_2017", "rate_2021"]), "rate_2017", "rate_2021")


@query(with_(SERIES, wide_sql()) + """, l AS (
  SELECT entity, year::INT AS year, v FROM wide UNPIVOT INCLUDE NULLS (v FOR year IN ("1995", "1996", "1997", "1998", "1999", "2000", "2001")))
SELECT entity, year, round(coalesce(v, (lag(v) OVER w + lead(v) OVER w) / 2, 2 * lag(v) OVER w - lag(v, 2) OVER w), 6) + 0.0 AS v
FROM l WINDOW w AS (PARTITION BY entity ORDER BY year)""")
def series_gap_fill(spark, sf):
    long = P.to_long(wide(spark, sf), ["entity"], "v")
    return rounded(P.fill_between_and_ahead(long, "entity", "year", "v"), "v")


@query(with_(PRICES) + """, t AS (SELECT year, sum(population * rate) / 100 AS total FROM prices GROUP BY year)
SELECT nation, prices.year, round(population * rate / 100 / total, 6) AS share FROM prices JOIN t ON prices.year = t.year""")
def share_of_world_total(spark, sf):
    p = prices(spark, sf)
    part = F.col("population") * F.col("rate") / 100
    totals = p.groupBy("year").agg(F.sum(part).alias("total"))
    out = P.share_of_total(p, totals, "year", part, "total", "share")
    return rounded(out.select("nation", "year", "share"), "share")


@query(with_(PRICES) + """, f AS (
  SELECT max(cpi) FILTER (nation = 3 AND year = 2000) / max(cpi) FILTER (nation = 3 AND year = 1996) AS f FROM prices)
SELECT nation, year, round(rate * f, 6) AS rate_scaled FROM prices, f""")
def reference_scaling(spark, sf):
    p = prices(spark, sf)
    here = F.col("nation") == 3
    factor = F.max(F.when(here & (F.col("year") == 2000), F.col("cpi"))) / F.max(
        F.when(here & (F.col("year") == 1996), F.col("cpi"))
    )
    out = P.times_reference(p, "rate", p, factor, "rate_scaled")
    return rounded(out.select("nation", "year", "rate_scaled"), "rate_scaled")


@query(with_(SERIES) + """
SELECT entity, reporting_year, round(CASE WHEN headcount = 0 THEN 0 ELSE (poverty_gap + 0.5) * headcount END / 2.15, 6) AS gap_index
FROM series""")
def shortfall_to_gap(spark, sf):
    gap = M.shortfall_to_population_gap(F.col("poverty_gap") + 0.5, "headcount") / LINE
    return series(spark, sf).select("entity", "reporting_year", r6(gap).alias("gap_index"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE l_returnflag WHEN 'A' THEN l_extendedprice / l_quantity WHEN 'N' THEN 50 * l_extendedprice / l_quantity
       WHEN 'R' THEN (50.0::DOUBLE / 90) * l_extendedprice / l_quantity END, 8) AS price_50kg FROM lineitem""")
def price_per_50_kg(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("int").cast("string"))
    price = M.price_per_50_kg("l_extendedprice", "q", "l_returnflag", {"A": 50.0, "N": 1.0, "R": 90.0})
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(price, 8).alias("price_50kg"))


@query(with_(HH, PRICES) + """
SELECT hhid, round(consumption * 65536 * (1 / (0.9::DOUBLE * 3)) / (hh_size * 365 * cpi / 100), 6) AS consumption_per_capita_per_day
FROM hh JOIN nation ON district = n_name JOIN prices p ON p.nation = n_nationkey AND p.year = hh.year""")
def deflated_consumption(spark, sf):
    hh = households(spark, sf)
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("district"))
    p = prices(spark, sf).select("nation", "year", (F.col("cpi") / 100).alias("def_temp_prix1997"))
    joined = (
        hh.join(n, "district").join(p, (F.col("nation") == F.col("n_nationkey")) & (hh.year == p.year))
        .withColumn("dtot", F.col("consumption") * 65536)
    )
    factor = M.curated_factor(F.lit(0.9), F.lit(3.0))
    out = M.deflated_consumption(joined, "dtot", "hh_size", factor)
    return out.select("hhid", r6("consumption_per_capita_per_day").alias("consumption_per_capita_per_day"))


@query(with_(SERIES, SURVEYS) + """, l AS (SELECT entity, arg_max(struct_pack(v := headcount), reporting_year).v AS v, max(reporting_year) AS y FROM series GROUP BY entity)
SELECT s.entity, survey_year, round(v, 6) AS latest, y AS latest_year, n_name AS place
FROM surveys s LEFT JOIN l ON s.entity = l.entity LEFT JOIN nation ON nation = n_nationkey""")
def left_join_chain(spark, sf):
    s = series(spark, sf)
    last = s.groupBy("entity").agg(
        F.max(F.struct("reporting_year", "headcount"))["headcount"].alias("latest"), F.max("reporting_year").alias("latest_year")
    )
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("place"))
    out = surveys(spark, sf).join(last, "entity", "left").join(names, "nation", "left")
    return out.select("entity", "survey_year", r6("latest").alias("latest"), "latest_year", "place")
