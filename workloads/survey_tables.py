"""Encoding, profiling, quality checks, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from welfarelens.functions import money as Y, text as X
from welfarelens.operators import encode as E, quality as Q, split as S
from workloads.registry import query
from workloads.tables import HH, POINTS, SERIES, households, points, rounded, series, table, with_

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


def _flags(column: str, values) -> str:
    return ", ".join(f"""CASE WHEN {column} = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS "{column}_{v}\"""" for v in values)


@query(with_(HH) + f"""
SELECT hhid, {_flags('area', PRIORITIES)}, {_flags('status', STATUSES)}, year < 1999 AS is_train FROM hh""")
def one_hot_align(spark, sf):
    hh = households(spark, sf).select("hhid", "area", "status", "year")
    train, test = E.one_hot_pair(
        hh.filter("year < 1999").withColumn("is_train", F.lit(True)).drop("year"),
        hh.filter("year >= 1999").withColumn("is_train", F.lit(False)).drop("year"),
        ["area", "status"], "double",
    )
    return train.unionByName(E.align_columns(test, train.columns, dtype="double"))


@query(with_(HH) + f"""
SELECT district, {', '.join(f"max(CASE WHEN area = '{v}' AND consumption > 7 THEN 1.0 ELSE 0.0 END)::DOUBLE AS \"area_{v}\"" for v in PRIORITIES)},
  0.0::DOUBLE AS area_other FROM hh WHERE area <> 'none' GROUP BY district""")
def one_hot_missing_columns(spark, sf):
    hh = households(spark, sf).select("district", F.when(F.col("consumption") > 7, F.col("area")).alias("area"))
    cats = E.category_lists(households(spark, sf).select("area"), ["area"])
    hot = E.one_hot(hh, cats, "double")
    flags = [c for c in hot.columns if c != "district"]
    out = hot.groupBy("district").agg(*[F.max(f"`{c}`").alias(c) for c in flags])
    return E.align_columns(out, [*out.columns, "area_other"], dtype="double")


@query(with_(HH) + "SELECT hhid, area, CASE WHEN status <> 'P' THEN status END AS status FROM hh")
def inverse_one_hot(spark, sf):
    hh = households(spark, sf).select("hhid", "area", "status")
    hot = E.one_hot(hh, {"area": PRIORITIES, "status": STATUSES})
    back = {f"area_{v}": ("area", v) for v in PRIORITIES}
    back |= {f"status_{v}": ("status", v) for v in ("F", "O")}
    return E.inverse_one_hot(hot, back).select("hhid", "area", "status")


@query("""
WITH q AS (SELECT d.doc_id, lang, source, quality, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, dense_rank() OVER (ORDER BY lang)::INT - 1 AS lang, dense_rank() OVER (ORDER BY source)::INT - 1 AS source,
  dense_rank() OVER (ORDER BY n_chars)::INT - 1 AS n_chars,
  CASE WHEN quality IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY quality NULLS LAST)::INT - 1 END AS quality FROM q""")
def category_codes(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    return E.category_codes(joined, ["lang", "source", "n_chars", "quality"])


@query(with_(HH) + f"""
SELECT district, {', '.join(f"max((area = '{v}')::INT) AS \"{v}\"" for v in PRIORITIES)} FROM hh WHERE consumption > 7.5 GROUP BY district""")
def membership_matrix(spark, sf):
    pairs = households(spark, sf).filter("consumption > 7.5").select("district", "area")
    return E.membership_matrix(pairs, "district", "area")


@query("""
SELECT p_brand, count(*) AS count, s_name AS description FROM part
LEFT JOIN supplier ON s_suppkey = substr(p_brand, 7)::INT AND s_acctbal > 0 GROUP BY p_brand, s_name""")
def item_frequency(spark, sf):
    desc = table(spark, sf, "supplier").filter("s_acctbal > 0").select(
        F.concat(F.lit("Brand#"), F.col("s_suppkey").cast("string")).alias("brand"), F.col("s_name").alias("description")
    )
    return E.item_frequency(table(spark, sf, "part"), "p_brand", desc, "brand")


@query(with_(HH) + """
SELECT 'district' AS "column", count(DISTINCT district) AS distinct_values FROM hh UNION ALL SELECT 'stratum', count(DISTINCT stratum) FROM hh
UNION ALL SELECT 'area', count(DISTINCT area) FROM hh UNION ALL SELECT 'village', count(DISTINCT village) FROM hh
UNION ALL SELECT 'status', count(DISTINCT status) FROM hh""")
def column_cardinality(spark, sf):
    return Q.cardinalities(households(spark, sf), ["district", "stratum", "area", "village", "status"])


@query(with_(HH) + """
SELECT * FROM (SELECT 'district' AS "column", count(DISTINCT district) AS distinct_values FROM hh
UNION ALL SELECT 'stratum', count(DISTINCT stratum) FROM hh UNION ALL SELECT 'area', count(DISTINCT area) FROM hh
UNION ALL SELECT 'village', count(DISTINCT village) FROM hh UNION ALL SELECT 'status', count(DISTINCT status) FROM hh
UNION ALL SELECT 'year', count(DISTINCT year) FROM hh UNION ALL SELECT 'hh_size', count(DISTINCT hh_size) FROM hh)
ORDER BY distinct_values DESC, "column" LIMIT 5""")
def top_cardinalities(spark, sf):
    columns = ["district", "stratum", "area", "village", "status", "year", "hh_size"]
    return Q.cardinalities(households(spark, sf), columns).orderBy(F.desc("distinct_values"), "column").limit(5)


@query("""
WITH q AS (SELECT d.doc_id, lang, quality, toxic, CASE WHEN n_chars > 5000 THEN '' ELSE source END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT c AS "column", round(n, 6) AS null_share, round(e, 6) AS empty_share FROM (
SELECT 'doc_id' AS c, avg((doc_id IS NULL)::INT) AS n, 0.0::DOUBLE AS e FROM q UNION ALL SELECT 'lang', avg((lang IS NULL)::INT), avg((lang = '')::INT) FROM q
UNION ALL SELECT 'quality', avg((quality IS NULL)::INT), 0 FROM q UNION ALL SELECT 'toxic', avg((toxic IS NULL)::INT), 0 FROM q
UNION ALL SELECT 'source', avg((source IS NULL)::INT), avg((source = '')::INT) FROM q)""")
def null_and_empty_shares(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", "lang", F.when(F.col("n_chars") > 5000, F.lit("")).otherwise(F.col("source")).alias("source")
    )
    joined = d.join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(Q.null_and_empty_shares(joined), "null_share", "empty_share")


@query("""
WITH q AS (SELECT d.doc_id, lang, quality, toxic, CASE WHEN n_chars > 5000 THEN '' ELSE source END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT 'doc_id' AS c, avg((doc_id IS NULL)::INT) AS n, 0.0::DOUBLE AS e FROM q UNION ALL SELECT 'lang', avg((lang IS NULL)::INT), avg((lang = '')::INT) FROM q
UNION ALL SELECT 'quality', avg((quality IS NULL)::INT), 0 FROM q UNION ALL SELECT 'toxic', avg((toxic IS NULL)::INT), 0 FROM q
UNION ALL SELECT 'source', avg((source IS NULL)::INT), avg((source = '')::INT) FROM q)
SELECT c AS "column", round(n, 6) AS null_share, round(e, 6) AS empty_share FROM s ORDER BY n + e DESC, c LIMIT 3""")
def emptiest_columns(spark, sf):
    """The three columns that lack most."""
    d = table(spark, sf, "documents").select(
        "doc_id", "lang", F.when(F.col("n_chars") > 5000, F.lit("")).otherwise(F.col("source")).alias("source")
    )
    joined = d.join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(Q.null_and_empty_shares(joined, top=3), "null_share", "empty_share")


def filled_cells(df):
    """(column, filled, different): which columns there are, and what they hold."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns]))
    each = df.select(cells.alias("c")).select("c.*").groupBy("column", "v").agg(F.count("v").alias("n"))
    return each.groupBy("column").agg(F.sum("n").alias("filled"), F.count("v").alias("different"))


@query(with_(HH) + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS filled, count(DISTINCT {c}) AS different FROM hh"
    for c in ("hh_size", "stratum", "area")
))
def columns_after_drops(spark, sf):
    """Ids, weights and fine geography leave the table; what is left is listed, so a column too many shows."""
    hh = households(spark, sf).select("hhid", "hh_wgt", "hh_size", "district", "stratum", "area")
    meta = spark.createDataFrame(
        [("district", True, False), ("stratum", True, True), ("area", False, None)],
        "variable_name string, geographic_indicator boolean, geographic_indicator_coarser boolean",
    )
    return filled_cells(E.drop_ids(E.drop_fine_geography(hh, meta)))


@query("""SELECT column_name AS "column", CASE WHEN column_name LIKE '%_nan' OR column_type = 'VARCHAR' THEN 'categorical' ELSE 'numeric' END AS kind
FROM (DESCRIBE SELECT *, o_custkey % 2 AS odd_nan FROM orders) WHERE column_type NOT LIKE 'TIMESTAMP%' AND column_type <> 'DATE'""")
def column_kinds(spark, sf):
    """Numeric and other columns of a table; dates are neither."""
    orders = table(spark, sf, "orders").withColumn("odd_nan", F.col("o_custkey") % 2)
    numeric, other = E.numeric_and_categorical(orders)
    rows = [(c, "numeric") for c in numeric] + [(c, "categorical") for c in other]
    return spark.createDataFrame(rows, "column string, kind string")


@query(with_(POINTS) + """SELECT vec_id, round(feature_0, 6) AS sat_feature_0, round(feature_1, 6) AS sat_feature_1, label FROM points""")
def prefixed_features(spark, sf):
    """A family's columns get its name, whatever way their header was written."""
    p = points(spark, sf).select("vec_id", F.col("feature_0").alias(""), F.col("feature_1").alias(" .1"), "label")
    named = p.toDF(*[X.feature_column_name(c) for c in p.columns])
    out = named.withColumnsRenamed(X.prefix_columns(named.columns, "feature", "sat"))
    return rounded(out, "sat_feature_0", "sat_feature_1")


@query(with_(HH) + """, f AS (SELECT sum(assets) / count(*) / 1000 AS factor FROM hh WHERE stratum = 'BUILDING')
SELECT district, round(avg(consumption * factor), 6) AS mean FROM hh, f GROUP BY district""")
def factor_lookup(spark, sf):
    """Consumption by the one factor of a table that holds for the country."""
    hh = households(spark, sf)
    factors = hh.groupBy("stratum").agg((F.sum("assets") / F.count(F.lit(1)) / 1000).alias("factor"))
    factor = Y.single_factor(factors, "stratum", "BUILDING", "factor")
    return rounded(hh.groupBy("district").agg(F.avg(F.col("consumption") * factor).alias("mean")), "mean")


def _equivalence_sql() -> str:
    numeric = ["l_quantity", "l_tax", "tax_copy", "tax_near", "l_extendedprice", "price_cents"]
    text = ["l_returnflag", "flag_code", "l_linestatus"]
    parts = []
    for i, a in enumerate(numeric):
        for b in numeric[i + 1 :]:
            parts.append(f"""SELECT '{a}' AS a, '{b}' AS b, CASE WHEN bool_and({a} IS NOT DISTINCT FROM {b}) THEN 'identical'
  WHEN bool_and(abs({a} - {b}) <= 1e-6 + 1e-6 * abs({b})) THEN 'nearly_identical'
  WHEN coalesce(bool_and({a} = {b}) FILTER ({a} = 0 OR {b} = 0), true) AND count(*) FILTER ({a} <> 0 AND {b} <> 0) > 10
    AND stddev_samp({b} / {a}) FILTER ({a} <> 0 AND {b} <> 0) < 1e-6 THEN 'proportional' END AS relation,
  avg({b} / {a}) FILTER ({a} <> 0 AND {b} <> 0) AS factor FROM li""")
    every = text + numeric
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if a in text:
                parts.append(f"""SELECT '{a}', '{b}', CASE WHEN count(DISTINCT {a}) = count(DISTINCT {b}) AND count(DISTINCT {a}) <= 100
  AND count(DISTINCT ({a}, {b})) = count(DISTINCT {a}) THEN 'one_to_one' END, NULL FROM li""")
    for c in [*text, *numeric, "one"]:
        parts.append(f"SELECT '{c}', NULL, CASE WHEN min({c}) = max({c}) THEN 'constant' END, NULL FROM li")
    return (
        """WITH li AS (SELECT l_quantity, l_tax, l_tax AS tax_copy, l_tax + 1e-9 AS tax_near, l_extendedprice,
  l_extendedprice * 100 AS price_cents, l_returnflag, ascii(l_returnflag)::VARCHAR AS flag_code, l_linestatus, 'x' AS one FROM lineitem),
r AS (""" + "\nUNION ALL ".join(parts) + """)
SELECT a AS column_a, b AS column_b, relation, round(CASE WHEN relation = 'proportional' THEN factor END, 6) AS factor
FROM r WHERE relation IS NOT NULL"""
    )


@query(_equivalence_sql())
def equivalent_columns(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_quantity", "l_tax", F.col("l_tax").alias("tax_copy"), (F.col("l_tax") + 1e-9).alias("tax_near"),
        "l_extendedprice", (F.col("l_extendedprice") * 100).alias("price_cents"),
        "l_returnflag", F.ascii("l_returnflag").cast("string").alias("flag_code"), "l_linestatus", F.lit("x").alias("one"),
    )
    out = Q.equivalent_columns(
        li, ["l_quantity", "l_tax", "tax_copy", "tax_near", "l_extendedprice", "price_cents"],
        ["l_returnflag", "flag_code", "l_linestatus", "one"],
    )
    return rounded(out, "factor")


@query(with_(HH) + "SELECT stratum, count(*) AS count, count(DISTINCT hh_wgt) AS weights FROM hh GROUP BY stratum")
def stratum_feasibility(spark, sf):
    return Q.stratum_feasibility(households(spark, sf), "stratum", "hh_wgt")


@query(with_(HH) + "SELECT hh_wgt, stratum, count(*) AS count FROM hh GROUP BY ALL")
def stratum_weight_cells(spark, sf):
    return Q.stratum_weight_cells(households(spark, sf), "stratum", "hh_wgt")


def _metadata(spark, sf):
    """One row per part, seen as the metadata of a variable."""
    p = table(spark, sf, "part")
    return p.select(
        F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"),
                 F.when(F.col("p_size") % 5 == 0, F.lit("_missing")).otherwise(F.lit(""))).alias("variable_name"),
        F.when(F.col("p_type") == "PROMO", F.lit("text"))
        .when(F.col("p_type").isin("ECONOMY", "STANDARD"), F.lit("categorical"))
        .otherwise(F.lit("numeric")).alias("data_type"),
        (F.col("p_size") > 25).alias("geographic_indicator"),
        F.when(F.col("p_size") < 48, F.col("p_size") % 4).alias("geographic_indicator_coarser"),
        F.concat(F.col("p_brand"), F.lit(" unit ethnicity"), F.col("p_type")).alias("variable_description"),
    )


_META = """meta AS (
  SELECT replace(p_name, ' ', '_') || '_' || p_partkey || CASE WHEN p_size % 5 = 0 THEN '_missing' ELSE '' END AS variable_name,
    CASE WHEN p_type = 'PROMO' THEN 'text' WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'categorical' ELSE 'numeric' END AS data_type,
    p_size > 25 AS geographic_indicator, CASE WHEN p_size < 48 THEN p_size % 4 END AS geographic_indicator_coarser,
    p_brand || ' unit ethnicity' || p_type AS variable_description FROM part)"""


@query(with_(_META) + """
SELECT variable_name, 'data_type' AS field, data_type AS value FROM meta WHERE data_type = 'text'
UNION ALL SELECT variable_name, 'geographic_indicator_coarser', geographic_indicator_coarser::VARCHAR FROM meta WHERE geographic_indicator_coarser NOT IN (0, 1)""")
def invalid_metadata(spark, sf):
    return Q.invalid_metadata(_metadata(spark, sf))


@query(with_(_META) + """
SELECT variable_name, 'unit' AS finding FROM meta WHERE NOT contains(variable_name, 'community')
UNION ALL SELECT variable_name, 'demographic' FROM meta
UNION ALL SELECT variable_name, 'numeric id or code' FROM meta WHERE regexp_matches(variable_name, '(?i)id|code') AND data_type = 'numeric'""")
def suspicious_variables(spark, sf):
    return Q.suspicious_variables(_metadata(spark, sf))


@query(with_(_META) + """
SELECT variable_name, 'metadata' AS found_in FROM meta UNION ALL SELECT unnest(['hhid', 'consumption', 'area']), 'data'""")
def metadata_mismatch(spark, sf):
    return Q.metadata_mismatch(households(spark, sf).select("hhid", "consumption", "area"), _metadata(spark, sf))


@query(with_(_META) + """
SELECT 'area_m' AS variable_name, 'indicator without metadata' AS finding UNION ALL
SELECT variable_name, 'numeric without indicator' FROM meta WHERE data_type = 'numeric' AND NOT ends_with(variable_name, '_missing')""")
def missing_indicator_audit(spark, sf):
    hh = households(spark, sf).select("hhid", "area", F.lit(0).alias("area_m"))
    return Q.missing_indicator_audit(hh, _metadata(spark, sf))


TYPED = [("c_name", "numeric"), ("c_custkey", "categorical"), ("c_acctbal", "numeric"), ("c_mktsegment", "categorical")]


@query(f"""
WITH m(n, t) AS (VALUES {', '.join(map(str, TYPED))}),
d AS (SELECT column_name, CASE column_type WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS p FROM (DESCRIBE customer)),
f AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, count({c}) AS filled, count(DISTINCT {c}) AS different FROM customer" for c, _ in TYPED)})
SELECT m.n AS variable_name, m.t AS data_type, p AS physical_type, CASE m.t WHEN 'numeric' THEN 'error' ELSE 'warning' END AS severity, filled, different
FROM m JOIN d ON m.n = column_name JOIN f ON m.n = c WHERE (m.t = 'numeric') = (p = 'string')""")
def type_mismatches(spark, sf):
    """Columns whose declared type is not the physical one, with what they hold."""
    cust = table(spark, sf, "customer")
    found = Q.type_mismatches(cust, spark.createDataFrame(TYPED, "variable_name string, data_type string"))
    return found.join(filled_cells(cust).withColumnRenamed("column", "variable_name"), "variable_name")


@query(with_(HH) + """
SELECT 'null_outcome' AS "check", count(*) FILTER (consumption IS NULL) AS failures FROM hh UNION ALL
SELECT 'null_weight', count(*) FILTER (weight IS NULL) FROM hh UNION ALL
SELECT 'size_times_weight', count(*) FILTER (abs(hh_size * hh_wgt - weight * CASE WHEN area = '5-LOW' THEN 1.001 ELSE 1 END) > 1e-8 + 1e-5 * weight) FROM hh UNION ALL
SELECT 'duplicate_id', coalesce(sum(n) FILTER (n > 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM hh GROUP BY hhid)""")
def survey_findings(spark, sf):
    hh = households(spark, sf).withColumn(
        "weight", F.col("weight") * F.when(F.col("area") == "5-LOW", F.lit(1.001)).otherwise(F.lit(1.0))
    )
    return Q.survey_findings(hh, "consumption", "weight")


@query(with_(SERIES) + """, x AS (SELECT entity, reporting_year, headcount, poverty_gap, headcount - poverty_gap / 2.15 AS d FROM series)
SELECT entity, reporting_year, round(d, 6) + 0.0 AS discrepancy, round(abs(d), 6) + 0.0 AS abs_discrepancy, coalesce(abs(d) >= 0.04, false) AS over_threshold FROM x""")
def rate_discrepancies(spark, sf):
    s = series(spark, sf).withColumn("published", F.col("poverty_gap") / 2.15)
    out = Q.rate_discrepancies(s, "headcount", "published").select(
        "entity", "reporting_year", "discrepancy", "abs_discrepancy", "over_threshold"
    )
    return rounded(out, "discrepancy", "abs_discrepancy")


@query(with_(SERIES) + """, a AS (SELECT entity, headcount AS v FROM series WHERE reporting_year = 1996), b AS (SELECT entity, headcount AS v FROM series WHERE reporting_year = 1999)
SELECT coalesce(a.entity, b.entity) AS entity, round(a.v, 6) AS headcount_new, round(b.v, 6) AS headcount_old FROM a FULL JOIN b ON a.entity = b.entity
WHERE NOT ((a.v IS NULL AND b.v IS NULL) OR coalesce(abs(a.v - b.v) <= 1e-8 + 1e-5 * abs(b.v), false))""")
def changed_rows(spark, sf):
    s = series(spark, sf)
    out = Q.changed_rows(
        s.filter("reporting_year = 1996"), s.filter("reporting_year = 1999"), "entity", "headcount"
    )
    return rounded(out, "headcount_new", "headcount_old")


@query(with_(SERIES) + """
SELECT round(avg((a.headcount IS NOT DISTINCT FROM b.headcount)::INT), 6) AS agreement
FROM series a LEFT JOIN series b ON a.entity = b.entity AND a.reporting_year = b.reporting_year - 1""")
def agreement_share(spark, sf):
    s = series(spark, sf)
    later = s.select(
        "entity", (F.col("reporting_year") - 1).alias("reporting_year"), F.col("headcount").alias("next")
    )
    return rounded(Q.agreement_share(s.join(later, ["entity", "reporting_year"], "left"), "headcount", "next"), "agreement")


# ---------------------------------------------------------------- splits


@query(with_(HH) + """, s AS (SELECT stratum || '-' || area AS strata, count(*) AS rows FROM hh GROUP BY 1),
b AS (SELECT *, floor(rows * 0.6 + 1e-9)::BIGINT AS base, greatest(rows * 0.6 - floor(rows * 0.6 + 1e-9), 0) AS rest FROM s),
q AS (SELECT strata, rows, base + (row_number() OVER (ORDER BY round(rest, 9) DESC, strata) <= (SELECT floor(sum(rows) * 0.6 + 0.5) - sum(base) FROM b))::INT AS train FROM b)
SELECT strata, 'train' AS split, train::BIGINT AS rows FROM q UNION ALL SELECT strata, 'test', (rows - train)::BIGINT FROM q""".replace("0.6", "0.6::DOUBLE"))
def stratified_split_counts(spark, sf):
    hh = households(spark, sf).withColumn("strata", X.strata_key("stratum", "area"))
    out = S.stratified_split(hh, "hhid", 0.6, 1234, ["strata"])
    return out.groupBy("strata", "split").agg(F.count(F.lit(1)).alias("rows"))


def order_sql(seed: int) -> str:
    """The random order of the splits, by the hash that both engines have."""
    return f"substr(md5('{seed}:' || hhid::VARCHAR), 1, 15), hhid::VARCHAR"


_QUOTAS = """, named AS (SELECT hhid, stratum || '-' || area AS strata FROM hh), s AS (SELECT strata, count(*) AS rows FROM named GROUP BY 1),
b AS (SELECT *, floor(rows * 0.6::DOUBLE + 1e-9)::BIGINT AS base, greatest(rows * 0.6::DOUBLE - floor(rows * 0.6::DOUBLE + 1e-9), 0) AS rest FROM s),
q AS (SELECT strata, base + (row_number() OVER (ORDER BY round(rest, 9) DESC, strata) <= (SELECT floor(sum(rows) * 0.6::DOUBLE + 0.5) - sum(base) FROM b))::INT AS train FROM b)"""


@query(with_(HH) + _QUOTAS + f""", r AS (SELECT *, row_number() OVER (PARTITION BY strata ORDER BY {order_sql(1234)}) AS r FROM named)
SELECT hhid, strata, CASE WHEN r <= train THEN 'train' ELSE 'test' END AS split FROM r JOIN q USING (strata)""")
def stratified_split(spark, sf):
    hh = households(spark, sf).withColumn("strata", X.strata_key("stratum", "area"))
    return S.stratified_split(hh, "hhid", 0.6, 1234, ["strata"]).select("hhid", "strata", "split")


@query(with_(HH) + """
SELECT 'train' AS split, floor(count(*) * 0.7)::BIGINT AS rows, round(1.0 / floor(count(*) * 0.7), 12) AS weight FROM hh
UNION ALL SELECT 'test', count(*) - floor(count(*) * 0.7)::BIGINT, round(1.0 / (count(*) - floor(count(*) * 0.7)), 12) FROM hh""")
def random_split_sizes(spark, sf):
    out = S.random_split(households(spark, sf).drop("weight"), "hhid", 0.7)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.round(F.max("weight"), 12).alias("weight"))


@query(with_(HH) + """, n AS (SELECT count(*) AS n FROM hh)
SELECT i::INT AS fold, (round_even((i + 1) * n / 7.0, 0) - round_even(i * n / 7.0, 0))::BIGINT AS rows FROM n, range(7) r(i)""")
def fold_sizes(spark, sf):
    out = S.even_folds(households(spark, sf), "hhid", 7, 11)
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))


@query(with_(HH) + f""", r AS (SELECT hhid, row_number() OVER (ORDER BY {order_sql(123456)}) AS r, count(*) OVER () AS rows FROM hh)
SELECT hhid, CASE WHEN r <= floor(rows * 0.7) THEN 'train' ELSE 'test' END AS split FROM r""")
def random_split_members(spark, sf):
    """Who is in which part, not only how many."""
    return S.random_split(households(spark, sf), "hhid", 0.7, weight="weight").select("hhid", "split")


@query(with_(HH) + f""", r AS (SELECT hhid, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {order_sql(11)}) AS r,
  count(*) OVER (PARTITION BY stratum) AS n FROM hh)
SELECT hhid, stratum, list_sum([(r > round_even(i * n / 5.0, 0))::INT FOR i IN [1, 2, 3, 4]])::INT AS fold FROM r""")
def stratified_fold_members(spark, sf):
    """Who is in which fold of a stratum."""
    return S.even_folds(households(spark, sf), "hhid", 5, 11, ["stratum"]).select("hhid", "stratum", "fold")


@query(with_(HH) + f""", r AS (SELECT hhid, row_number() OVER (ORDER BY {order_sql(7)}) AS place, count(*) OVER () AS n FROM hh)
SELECT hhid, place, place <= floor(0.1 * n) AS sampled FROM r""")
def shuffled_rows(spark, sf):
    """The whole table in random order, and a tenth of it."""
    hh = S.shuffled(households(spark, sf), "hhid", 7)
    n = hh.agg(F.count(F.lit(1)).alias("n"))
    return hh.crossJoin(F.broadcast(n)).select("hhid", "place", (F.col("place") <= F.floor(F.col("n") * 0.1)).alias("sampled"))


@query(with_(HH) + """, n AS (SELECT stratum, count(*) AS n FROM hh GROUP BY stratum)
SELECT stratum, i::INT AS fold, (round_even((i + 1) * n / 5.0, 0) - round_even(i * n / 5.0, 0))::BIGINT AS rows FROM n, range(5) r(i)""")
def stratified_fold_sizes(spark, sf):
    out = S.even_folds(households(spark, sf), "hhid", 5, 11, ["stratum"])
    return out.groupBy("stratum", "fold").agg(F.count(F.lit(1)).alias("rows"))


@query(with_(HH) + """
SELECT CASE WHEN district <> 'NATION_3' THEN district END AS district, 1::BIGINT AS folds, count(*) AS rows FROM hh GROUP BY ALL""")
def group_folds(spark, sf):
    hh = households(spark, sf).withColumn("district", F.when(F.col("district") != "NATION_3", F.col("district")))
    out = S.group_folds(hh, "district", 5)
    # no group spans two folds
    per = out.groupBy("district", "fold").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("district").agg(F.count(F.lit(1)).alias("folds"), F.sum("n").alias("rows"))


@query(with_(HH) + """
SELECT count(*) AS full_rows, count(*) AS part_rows, true AS complete FROM hh""")
def split_integrity(spark, sf):
    hh = households(spark, sf)
    marked = S.stratified_split(hh, "hhid", 0.6, 1234, ["stratum"])
    parts = marked.groupBy("split").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("part_rows"))
    full = hh.agg(F.count(F.lit(1)).alias("full_rows"))
    complete = Q.split_integrity(hh, *(marked.filter(F.col("split") == p) for p in ("train", "test")))
    return full.crossJoin(F.broadcast(parts)).withColumn("complete", F.lit(complete))
