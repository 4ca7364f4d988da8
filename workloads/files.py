"""Readers and sinks: the given tables written in the layouts the readers expect, and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from welfarelens.operators import encode as E
from welfarelens.session import intermediate_folder
from welfarelens.sources import readers as I, writers as O
from workloads.registry import query
from workloads.tables import HH, PRICES, YEARS, households, prices_wide, prices_wide_sql, r6, rounded, table, with_


def _folder(spark) -> str:
    return intermediate_folder(spark, "files")


@query(with_(PRICES, prices_wide_sql("cpi", "c")) + f"""
SELECT n_name AS "Country Name", lpad(c.nation::VARCHAR, CASE WHEN c.nation < 10 THEN 2 ELSE 3 END, '0') AS "Country Code", {', '.join(f'round(c."{y}", 6) AS "{y}"' for y in YEARS)}
FROM c JOIN nation ON c.nation = n_nationkey""")
def indicator_csv_with_preamble(spark, sf):
    path = _folder(spark)
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    wide = prices_wide(spark, sf, "cpi").join(names, "nation")
    code = F.col("nation").cast("string")
    code = F.when(F.col("nation") < 10, F.lpad(code, 2, "0")).otherwise(F.lpad(code, 3, "0"))  # codes of any length
    cells = F.to_csv(F.struct("n_name", code, *YEARS))
    header = '"Country Name","Country Code",' + ",".join(f'"{y}"' for y in YEARS) + ","
    top = spark.createDataFrame([('"Data Source","Indicators",',), ("",), ('"Last Updated","2025-07-01",',), (header,)], "value string")
    # one file: the header belongs to the file of its rows
    rows = top.withColumn("o", F.monotonically_increasing_id() - 2**40).unionByName(wide.select(cells.alias("value"), F.lit(0).cast("long").alias("o")))
    rows.coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return rounded(I.read_indicator_csv(spark, path), *YEARS)


@query("""SELECT c_custkey AS key, round(c_acctbal, 2) AS balance FROM customer WHERE c_mktsegment = 'BUILDING'""")
def newest_dated_csv(spark, sf):
    folder = _folder(spark)
    cust = table(spark, sf, "customer")
    O.write_csv_dated(cust.filter("c_acctbal < 0"), folder, "table", dt.date(2024, 12, 31))
    O.write_csv_dated(cust.filter("c_mktsegment = 'BUILDING'"), folder, "table", dt.date(2025, 9, 3))
    O.write_csv_dated(cust.filter("c_mktsegment = 'MACHINERY'"), folder, "table", dt.date(2025, 2, 28))
    newest = I.newest_file(spark, f"{folder}/table_*.csv/part-*.csv")
    pruned = I.read_csv_columns(spark, newest, ["c_custkey", "c_acctbal"], ["key", "balance"])
    return pruned.select(F.col("key").cast("long").alias("key"), F.round(F.col("balance").cast("double"), 2).alias("balance"))


@query(with_(HH) + """
SELECT status AS entity, CASE WHEN year < 1999 THEN 'train' ELSE 'test' END AS part, count(*) AS rows, round(sum(weight), 3) AS weight FROM hh GROUP BY ALL""")
def entity_folders(spark, sf):
    root = _folder(spark)
    hh = households(spark, sf).select("hhid", "consumption", "weight", "status", "year")
    # bounded by the statuses there are
    statuses = sorted(r[0] for r in hh.select("status").distinct().collect())
    for status in statuses:
        for part, cond in (("train", "year < 1999"), ("test", "year >= 1999")):
            own = hh.filter((F.col("status") == status) & F.expr(cond)).drop("status")
            O.write_parquet(own, f"{root}/{status}/cleaned/{part}.parquet")
    out = I.read_entities(spark, root)
    return out.groupBy("entity", "part").agg(F.count(F.lit(1)).alias("rows"), r6(F.sum("weight"), 3).alias("weight"))


@query("""SELECT 'supplier-' || n_name AS list, s_name AS covariate FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def lists_tagged_by_file(spark, sf):
    root = _folder(spark)
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = table(spark, sf, "supplier").join(names, "s_nationkey")
    s.select(F.col("s_name").alias("covariate"), F.concat(F.lit("supplier-"), "n_name").alias("list")).write.partitionBy(
        "list"
    ).option("header", True).csv(root)
    # part files carry the list in their folder's name
    return I.read_tagged(spark, f"{root}/*", "covariate string", "list", pattern=r"list=([^/]+)/[^/]+$")


@query("""
SELECT l_returnflag AS policy_type, CASE WHEN l_returnflag = 'A' THEN 'all' END AS features, CASE WHEN l_returnflag <> 'A' THEN l_linenumber END AS d,
       round(avg(l_extendedprice), 4) AS cost FROM lineitem WHERE l_returnflag <> 'R' OR l_linenumber <> 3
GROUP BY l_returnflag, CASE WHEN l_returnflag <> 'A' THEN l_linenumber END""")
def results_appended(spark, sf):
    path, kept = _folder(spark), _folder(spark)
    li = table(spark, sf, "lineitem")
    cost = F.avg("l_extendedprice").alias("cost")
    O.append_result(li.filter("l_returnflag = 'A'").agg(cost), path, policy_type="A", features="all")
    for flag in ("N", "R"):
        by_line = li.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_linenumber").alias("d")).agg(cost)
        O.append_result(by_line, path, policy_type=flag)
    O.rewrite_without(I.read_results(spark, path), (F.col("policy_type") == "R") & (F.col("d") == 3), kept)
    return rounded(I.read_results(spark, kept).select("policy_type", "features", "d", "cost"), "cost", digits=4)


@query("""
SELECT 'rows' AS indicator, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'total', round(sum(o_totalprice), 2) FROM orders
UNION ALL SELECT 'top', max(o_totalprice) FROM orders""")
def scalars_as_rows(spark, sf):
    out = O.key_value(
        table(spark, sf, "orders"),
        {"rows": F.count(F.lit(1)), "total": F.sum("o_totalprice"), "top": F.max("o_totalprice")},
    )
    return rounded(out, "value", digits=2)


@query("""SELECT s_name AS economy, s_suppkey AS code FROM supplier""")
def rows_above_blank_row(spark, sf):
    path = _folder(spark)
    s = table(spark, sf, "supplier").select(F.lit(1).alias("o"), F.col("s_name").alias("economy"), F.col("s_suppkey").alias("code"))
    rest = spark.createDataFrame([(2, None, None), (3, "Aggregates", 1), (4, None, None)], "o int, economy string, code long")
    ordered = s.unionByName(rest).orderBy("o", "code")
    ordered.select("economy", "code").write.option("header", True).csv(path)
    return I.above_first_blank_row(spark, path, "economy string, code long")


@query(with_(HH) + """
SELECT hhid, assets, consumption, CASE WHEN area = '1-URGENT' THEN 1.0 ELSE 0.0 END::DOUBLE AS urgent FROM hh WHERE district = 'NATION_3'""")
def covariate_projection(spark, sf):
    hh = households(spark, sf).withColumn("urgent", F.when(F.col("area") == "1-URGENT", 1.0).otherwise(0.0))
    meta = spark.createDataFrame(
        [("wealth", ["assets", "consumption"]), ("need", ["urgent"])], "covariate string, columns array<string>"
    )
    return E.select_covariates(hh, meta, ["wealth", "need"], ["hhid"], F.col("district") == "NATION_3")


@query("""SELECT s_suppkey AS code, s_name AS name, s_acctbal AS balance FROM supplier""")
def join_by_position(spark, sf):
    one, two = _folder(spark), _folder(spark)
    s = table(spark, sf, "supplier")
    ordered = s.repartitionByRange(3, "s_suppkey").sortWithinPartitions("s_suppkey")
    ordered.select("s_suppkey", "s_name").write.option("header", True).csv(one)
    s.orderBy("s_suppkey").select("s_acctbal").write.option("header", True).csv(two)
    left = I.read_with_position(spark, one, "code long, name string")
    return I.join_by_position(left, I.read_with_position(spark, two, "balance double")).select("code", "name", "balance")


@query(with_(PRICES, prices_wide_sql("cpi", "c")) + f"""
SELECT nation, {', '.join(f'round("{y}", 6) AS "{y}"' for y in YEARS)} FROM c""")
def typed_csv_with_year_labels(spark, sf):
    path = _folder(spark)
    wide = prices_wide(spark, sf, "cpi")
    wide.toDF("nation", *[f"{y} [YR{y}]" for y in YEARS]).write.option("header", True).csv(path)
    schema = "nation long, " + ", ".join(f"`{y} [YR{y}]` string" for y in YEARS)
    return rounded(I.plain_year_headers(I.read_csv(spark, path, schema)), *YEARS)


@query(with_(HH) + "SELECT district, count(*) AS rows, round(sum(CASE WHEN hh_size = 3 THEN NULL ELSE assets END), 4) AS assets FROM hh GROUP BY district")
def parquet_parts(spark, sf):
    """Parquet files of several folders, some columns of them, NaN as NULL."""
    hh = households(spark, sf).withColumn("assets", F.when(F.col("hh_size") == 3, F.lit(float("nan"))).otherwise(F.col("assets")))
    folders = []
    for size in (3, 5):
        folders.append(_folder(spark))
        part = hh.filter(F.col("hh_size") <= 3) if size == 3 else hh.filter(F.col("hh_size") > 3)
        part.select("hhid", "district", "assets", "status").write.parquet(folders[-1])
    read = I.read_parquet(spark, folders, ["district", "assets"])
    out = read.groupBy("district").agg(F.count(F.lit(1)).alias("rows"), F.sum("assets").alias("assets"))
    return rounded(out, "assets", digits=4)
