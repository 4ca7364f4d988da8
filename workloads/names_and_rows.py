"""Text keys, projections, filters, joins and duplicates on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from welfarelens.functions import text as X
from welfarelens.operators import curves as C, dedup as U, encode as E, quality as Q
from workloads.registry import query
from workloads.tables import HH, SERIES, households, r6, rounded, series, table, with_


@query(r"""SELECT doc_id, lower(regexp_replace(strip_accents(text), '^\s+|\s+$', '', 'g')) AS name FROM documents""")
def normalized_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_text("text").alias("name"))


@query(r"""
SELECT doc_id, lower(replace(regexp_replace(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'), '[^\w\s]', '', 'g'), ' ', '_')) AS slug
FROM documents""")
def slugs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.slug("text").alias("slug"))


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(url), '^\s+|\s+$', '', 'g')), '[^\w\s]', '', 'g'), '\s+', '_', 'g') AS key FROM pages""")
def join_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.country_key("url").alias("key"))


FIXES = [("red ", "Crimson"), ("gear", "Gear Wheel"), ("Crim", "Scarlet"), ("bolt", "Bolt and Nut")]


@query("""
WITH a AS (SELECT p_partkey, CASE WHEN contains(p_name, 'red ') THEN 'Crimson' ELSE p_name END AS n FROM part),
b AS (SELECT p_partkey, CASE WHEN contains(n, 'gear') THEN 'Gear Wheel' ELSE n END AS n FROM a),
c AS (SELECT p_partkey, CASE WHEN contains(n, 'Crim') THEN 'Scarlet' ELSE n END AS n FROM b)
SELECT p_partkey, CASE WHEN contains(n, 'bolt') THEN 'Bolt and Nut' ELSE n END AS name FROM c""")
def substring_fixes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.fix_containing("p_name", FIXES).alias("name"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS replaced,
       CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS mapped FROM orders""")
def alias_map(spark, sf):
    names = {"F": "final", "O": "open"}
    return table(spark, sf, "orders").select(
        "o_orderkey", X.replace_values("o_orderstatus", names).alias("replaced"),
        X.map_values("o_orderstatus", names).alias("mapped"),
    )


@query("""
SELECT event_id, round(try_cast(rtrim(props, '}') AS DOUBLE), 6) AS bad, round(value / 100, 6) AS fraction,
       try_cast(regexp_extract(props, '\\d+') AS DOUBLE) AS number FROM events""".replace("\\\\", "\\"))
def percent_and_number_text(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        X.to_number(F.rtrim(F.col("props"))).alias("bad"),
        r6(X.percent_to_fraction(F.concat(F.col("value").cast("string"), F.lit("%")))).alias("fraction"),
        X.to_number(F.regexp_extract("props", r"\d+", 0)).alias("number"),
    )


@query("""
SELECT c_custkey, lower(c_mktsegment) AS lowered, split_part(c_name, '#', 2)::INT AS number,
       substr(c_name, 10) AS suffix, CASE WHEN length(c_name) > 12 THEN substr(c_name, 1, 9) || '...' ELSE c_name END AS short
FROM customer""")
def text_pieces(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.lower("c_mktsegment").alias("lowered"),
        F.split("c_name", "#")[1].cast("int").alias("number"),
        F.expr("substring(c_name, 10)").alias("suffix"),
        X.truncate("c_name", 12).alias("short"),
    )


@query("""
SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 47) || '...' ELSE text END AS label FROM documents""")
def truncated_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.truncate("text", 50).alias("label"))


@query("""
SELECT d.doc_id, d.lang || '-' || coalesce(quality::VARCHAR, 'nan') AS strata FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def strata_key(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select("doc_id", X.strata_key("lang", "quality").alias("strata"))


@query(r"""
SELECT doc_id FROM documents WHERE (regexp_matches(text, '(?i)the|que') AND NOT contains(text, 'benchmark')) OR n_chars IS NULL""")
def text_row_filter(spark, sf):
    d = table(spark, sf, "documents")
    hit = F.col("text").rlike("(?i)the|que") & ~F.col("text").contains("benchmark")
    return d.filter(hit | F.col("n_chars").isNull()).select("doc_id")


@query(with_(HH) + """
SELECT hhid, 2022 AS source_year, CASE WHEN area = '1-URGENT' AND consumption < 2.15 THEN 'priority' WHEN status = 'F' THEN 'closed' ELSE 'other' END AS method,
       round(consumption * 19.5 * 365 / 3.0185 / 1e3, 6) AS scaled
FROM hh WHERE status IN ('F', 'O') AND NOT (assets < 0) AND consumption IS NOT NULL""")
def conditional_update(spark, sf):
    hh = households(spark, sf).filter(
        F.col("status").isin("F", "O") & ~(F.col("assets") < 0) & F.col("consumption").isNotNull()
    )
    method = (
        F.when((F.col("area") == "1-URGENT") & (F.col("consumption") < 2.15), F.lit("priority"))
        .when(F.col("status") == "F", F.lit("closed"))
        .otherwise(F.lit("other"))
    )
    out = hh.select(
        "hhid", method.alias("method"),
        r6(F.col("consumption") * 19.5 * 365 / 3.0185 / 1e3).alias("scaled"),
    )
    return E.insert_after(out, "hhid", "source_year", F.lit(2022))


@query(with_(SERIES) + """, s AS (
  SELECT reporting_year, headcount, entity, n / sum(n) OVER (PARTITION BY reporting_year) AS share FROM series)
SELECT entity, reporting_year, coalesce(headcount >= 0.1, false) AS rate_met, coalesce(share >= 0.001, false) AS share_met,
       entity IN (1, 2, 3) AS manual,
       (coalesce(headcount >= 0.1, false) AND coalesce(share >= 0.001, false)) OR entity IN (1, 2, 3) AS eligible FROM s""")
def eligibility_rule(spark, sf):
    s = series(spark, sf)
    totals = s.groupBy("reporting_year").agg(F.sum("n").alias("total"))
    rate = F.coalesce(F.col("headcount") >= 0.1, F.lit(False))
    share = F.coalesce(F.col("n") / F.col("total") >= 0.001, F.lit(False))
    manual = F.col("entity").isin(1, 2, 3)
    return s.join(totals, "reporting_year").select(
        "entity", "reporting_year", rate.alias("rate_met"), share.alias("share_met"), manual.alias("manual"),
        ((rate & share) | manual).alias("eligible"),
    )


# ---------------------------------------------------------------- joins


@query("""
SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name""")
def inner_join_renamed_keys(spark, sf):
    n, r, c = (table(spark, sf, t) for t in ("nation", "region", "customer"))
    joined = n.join(r, n.n_regionkey == r.r_regionkey).join(c, c.c_nationkey == n.n_nationkey, "left")
    return joined.groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("customers"))


@query("""
WITH a AS (SELECT o_custkey AS k, count(*) AS rows, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey AS k, count(*) AS rows FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.rows AS rows_left, b.rows AS rows_right FROM a FULL JOIN b ON a.k = b.k""")
def outer_join_suffixes(spark, sf):
    o = table(spark, sf, "orders")
    a = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("rows_left"))
    b = o.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("rows_right"))
    return a.join(b, "k", "full")


@query("""
WITH a AS (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer), b AS (SELECT o_custkey AS k, o_orderstatus AS seg2, max(o_totalprice) AS top FROM orders GROUP BY ALL),
c AS (SELECT DISTINCT o_custkey AS k, o_orderstatus AS seg2 FROM orders WHERE o_totalprice > 300000)
SELECT b.k, b.seg2, seg, round(top, 2) AS top FROM a JOIN b ON a.k = b.k JOIN c ON b.k = c.k AND b.seg2 = c.seg2""")
def natural_join(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("seg2"), "o_totalprice")
    b = o.groupBy("k", "seg2").agg(F.max("o_totalprice").alias("top"))
    c = o.filter("o_totalprice > 300000").select("k", "seg2").distinct()

    def natural(x, y):
        return x.join(y, [n for n in x.columns if n in y.columns])

    return rounded(natural(natural(a, b), c), "top", digits=2)


@query("""
SELECT s_suppkey, 'used' AS kind FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)
UNION ALL SELECT s_suppkey, 'unused' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)""")
def semi_and_anti_join(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey")
    used = table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return s.join(used, "s_suppkey", "left_semi").withColumn("kind", F.lit("used")).unionByName(
        s.join(used, "s_suppkey", "left_anti").withColumn("kind", F.lit("unused"))
    )


@query(with_(HH) + """
SELECT a.hhid AS row_id, round(a.consumption, 6) AS consumption, round(greatest(2.15 - b.consumption, 0), 6) AS ev_transfer
FROM hh a JOIN hh b ON a.hhid = b.hhid""")
def join_by_row_id(spark, sf):
    hh = households(spark, sf)
    a = hh.select(F.col("hhid").alias("row_id"), r6("consumption").alias("consumption"))
    b = hh.select(F.col("hhid").alias("row_id"), r6(F.greatest(2.15 - F.col("consumption"), F.lit(0.0))).alias("ev_transfer"))
    return a.join(b, "row_id")


# ---------------------------------------------------------------- groups and duplicates


@query(with_(HH) + """
SELECT village, arg_min(hhid, hhid) AS hhid, arg_min(area, hhid) AS area, arg_min(status, hhid) AS status FROM hh GROUP BY village""")
def dedup_keep_first(spark, sf):
    hh = households(spark, sf).select("village", "hhid", "area", "status")
    return U.keep_first(hh, ["village"], ["hhid"])


@query(with_(HH) + """
SELECT village, status, max(hhid) AS hhid, arg_max(area, hhid) AS area FROM hh GROUP BY village, status""")
def dedup_keep_last(spark, sf):
    hh = households(spark, sf).select("village", "status", "hhid", "area")
    return U.keep_last(hh, ["village", "status", "not_there"], ["hhid"])


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    return U.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN min(l_tax) < max(l_tax) THEN 'l_tax' END,
       CASE WHEN min(l_returnflag) < max(l_returnflag) THEN 'l_returnflag' END) AS conflicts
FROM lineitem GROUP BY l_orderkey, l_linenumber
HAVING count(*) > 1 AND (min(l_tax) < max(l_tax) OR min(l_returnflag) < max(l_returnflag))""")
def conflicting_duplicates(spark, sf):
    return U.conflicting_duplicates(
        table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_tax", "l_returnflag"]
    )


@query("""
SELECT s_suppkey AS key, s_acctbal AS balance, NULL AS segment, NULL AS brand, 'supplier' AS source FROM supplier
UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, NULL, 'customer' FROM customer
UNION ALL SELECT p_partkey, NULL, NULL, p_brand, 'part' FROM part""")
def union_with_drift(spark, sf):
    return U.union_labelled(
        {
            "supplier": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")),
            "customer": table(spark, sf, "customer").select(
                F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
            ),
            "part": table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand")),
        },
        "source",
    )


@query("""
SELECT min(m) AS shared FROM (SELECT max(l_extendedprice) AS m FROM lineitem GROUP BY l_suppkey)""")
def max_of_shared_range(spark, sf):
    top = C.shared_maximum(table(spark, sf, "lineitem"), "l_extendedprice", "l_suppkey")
    # the operator returns a number for the driver; shown here beside the rows that reach it
    return table(spark, sf, "lineitem").filter(F.col("l_extendedprice") == top).select(
        F.col("l_extendedprice").alias("shared")
    ).distinct()


@query(with_(HH) + """
SELECT district, arg_min(area, hhid) AS area, arg_min(stratum, hhid) AS stratum FROM hh GROUP BY district""")
def group_first(spark, sf):
    return Q.group_first(households(spark, sf), "district", ["area", "stratum"], "hhid")


@query("""
WITH a AS (SELECT l_suppkey, l_discount AS v, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey, l_tax AS v, count(*) AS n FROM lineitem GROUP BY ALL),
am AS (SELECT l_suppkey, arg_min(v, (-n, v)) AS l_discount FROM a GROUP BY 1), bm AS (SELECT l_suppkey, arg_min(v, (-n, v)) AS l_tax FROM b GROUP BY 1)
SELECT am.l_suppkey, l_discount, l_tax FROM am JOIN bm ON am.l_suppkey = bm.l_suppkey""")
def group_mode(spark, sf):
    return Q.group_mode(table(spark, sf, "lineitem"), "l_suppkey", ["l_discount", "l_tax"])


@query(with_(HH) + """
SELECT hhid, hh.district, t.total FROM hh JOIN (SELECT district, sum(weight) AS total FROM hh GROUP BY district) t ON hh.district = t.district""")
def group_sum_joined_back(spark, sf):
    hh = households(spark, sf).select("hhid", "district", "weight")
    return hh.join(hh.groupBy("district").agg(F.sum("weight").alias("total")), "district").drop("weight")


@query("""
SELECT l_suppkey, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice,
       round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY l_suppkey""")
def group_means(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(*[F.avg(c).alias(c) for c in cols])
    return rounded(rounded(out, "l_quantity", "l_discount", "l_tax"), "l_extendedprice", digits=4)


@query(with_(HH) + "SELECT district, area, count(*) AS count FROM hh GROUP BY ALL")
def group_counts(spark, sf):
    return Q.group_sizes(households(spark, sf), ["district", "area"]).orderBy(F.desc("count"), "district", "area")


@query(with_(HH) + """
SELECT 'weights per stratum' AS kind, stratum AS key, count(DISTINCT hh_wgt) AS distinct_values FROM hh GROUP BY stratum
UNION ALL SELECT 'strata per weight', hh_wgt::VARCHAR, count(DISTINCT stratum) FROM hh GROUP BY hh_wgt""")
def group_distinct(spark, sf):
    hh = households(spark, sf)
    a = Q.group_distinct(hh, "stratum", "hh_wgt").select(
        F.lit("weights per stratum").alias("kind"), F.col("stratum").alias("key"), "distinct_values"
    )
    b = Q.group_distinct(hh, "hh_wgt", "stratum").select(
        F.lit("strata per weight").alias("kind"), F.col("hh_wgt").cast("string").alias("key"), "distinct_values"
    )
    return a.unionByName(b)


@query("SELECT value, count(*) AS count FROM events WHERE value IS NOT NULL GROUP BY value")
def value_counts(spark, sf):
    return Q.value_counts(table(spark, sf, "events"), "value")


@query("""
SELECT p_brand, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_name, p_brand LIMIT 20""")
def top_rows(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_name", "p_retailprice").orderBy(
        F.desc("p_retailprice"), "p_name", "p_brand"
    ).limit(20)
