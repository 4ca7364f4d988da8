"""The survey-like views the queries run on, in Spark and as SQL text.

``hh``       one row per order, seen as a household: consumption, weight, place
``series``   one row per customer and year: headcount and gap, years missing where there were no orders
``wide``     ``series`` with one column per year
``surveys``  one row per customer: the year and the price base of its survey
``prices``   one row per nation and year: three price-like indicators
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

LINE = 2.15
YEARS = [str(y) for y in range(1995, 2002)]


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. Its schema is read from the file once, not by a job per query."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def r6(c, digits: int = 6):
    """Rounded, and without -0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in columns})


def households(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation")
    size = (F.col("o_custkey") % 7 + 1).cast("double")
    wgt = F.lit(1.0) + (F.col("o_orderkey") % 8) / F.lit(8.0)
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("hhid"),
            (F.col("o_totalprice") / 65536.0).alias("consumption"),
            size.alias("hh_size"),
            wgt.alias("hh_wgt"),
            (size * wgt).alias("weight"),
            F.col("n_name").alias("district"),
            F.col("c_mktsegment").alias("stratum"),
            F.col("o_orderpriority").alias("area"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_custkey").alias("village"),
            F.col("c_acctbal").alias("assets"),
            F.year("o_orderdate").cast("int").alias("year"),
        )
    )


HH = """hh AS (
  SELECT o_orderkey AS hhid, o_totalprice / 65536.0 AS consumption,
         (o_custkey % 7 + 1)::DOUBLE AS hh_size, 1.0::DOUBLE + (o_orderkey % 8) / 8.0::DOUBLE AS hh_wgt,
         (o_custkey % 7 + 1)::DOUBLE * (1.0::DOUBLE + (o_orderkey % 8) / 8.0::DOUBLE) AS weight,
         n_name AS district, c_mktsegment AS stratum, o_orderpriority AS area, o_orderstatus AS status,
         o_custkey AS village, c_acctbal AS assets, year(o_orderdate)::INT AS year
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def series(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("o_totalprice") / 65536.0
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("int").alias("reporting_year"))
        .agg(
            F.when(F.count(F.lit(1)) > 1, F.avg(F.when(y < LINE, 1.0).otherwise(0.0))).alias("headcount"),
            F.avg(F.greatest(LINE - y, F.lit(0.0))).alias("poverty_gap"),
            F.avg(y).alias("mean_consumption"),
            F.count(F.lit(1)).alias("n"),
        )
    )


SERIES = """series AS (
  SELECT o_custkey AS entity, year(o_orderdate)::INT AS reporting_year,
         CASE WHEN count(*) > 1 THEN avg(CASE WHEN o_totalprice / 65536.0 < 2.15 THEN 1.0 ELSE 0.0 END) END AS headcount,
         avg(greatest(2.15 - o_totalprice / 65536.0, 0.0)) AS poverty_gap,
         avg(o_totalprice / 65536.0) AS mean_consumption, count(*) AS n
  FROM orders GROUP BY ALL)"""


def wide(spark: SparkSession, sf: str, value: str = "headcount") -> DataFrame:
    s = series(spark, sf)
    return s.groupBy("entity").agg(
        *[F.max(F.when(F.col("reporting_year") == int(y), F.col(value))).alias(y) for y in YEARS]
    )


def wide_sql(value: str = "headcount", name: str = "wide") -> str:
    cols = ", ".join(f'max(CASE WHEN reporting_year = {y} THEN {value} END) AS "{y}"' for y in YEARS)
    return f"{name} AS (SELECT entity, {cols} FROM series GROUP BY entity)"


def surveys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity"),
        F.col("c_nationkey").alias("nation"),
        (1994 + F.col("c_custkey") % 9).cast("int").alias("survey_year"),
        (1995 + (F.col("c_custkey") % 13) / 2.0).alias("base_year"),
    )


SURVEYS = """surveys AS (
  SELECT c_custkey AS entity, c_nationkey AS nation, (1994 + c_custkey % 9)::INT AS survey_year,
         1995 + (c_custkey % 13) / 2.0::DOUBLE AS base_year FROM customer)"""


def prices(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").cast("int").alias("year")).agg(
        (F.avg("o_totalprice") / 1024).alias("cpi"),
        (F.max("o_totalprice") / 131072).alias("ppp"),
        (F.min("o_totalprice") / 1024).alias("rate"),
        (F.count(F.lit(1)) * 1.0).alias("population"),
    )


PRICES = """prices AS (
  SELECT c_nationkey AS nation, year(o_orderdate)::INT AS year, avg(o_totalprice) / 1024 AS cpi,
         max(o_totalprice) / 131072 AS ppp, min(o_totalprice) / 1024 AS rate, count(*)::DOUBLE AS population
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def prices_wide(spark: SparkSession, sf: str, value: str) -> DataFrame:
    return prices(spark, sf).groupBy("nation").agg(
        *[F.max(F.when(F.col("year") == int(y), F.col(value))).alias(y) for y in YEARS]
    )


def prices_wide_sql(value: str, name: str) -> str:
    cols = ", ".join(f'max(CASE WHEN year = {y} THEN {value} END) AS "{y}"' for y in YEARS)
    return f"{name} AS (SELECT nation, {cols} FROM prices GROUP BY nation)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(
        "vec_id", "label",
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(["x", "y", "feature_0", "feature_1"])],
    )


POINTS = """points AS (
  SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y,
         embedding[3]::DOUBLE AS feature_0, embedding[4]::DOUBLE AS feature_1 FROM embeddings)"""


def sites_and_tiles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Survey sites from the first two numbers of every embedding, feature tiles from the next four."""
    e = table(spark, sf, "embeddings")
    sites = points(spark, sf).select(F.col("vec_id").alias("site"), "x", "y")
    names = ["x", "y", "feature_0", "feature_1"]
    tiles = e.select(
        F.col("vec_id").alias("tile"), *[F.col("embedding")[i + 2].cast("double").alias(n) for i, n in enumerate(names)]
    )
    return sites, tiles


SITES = """sites AS (SELECT vec_id AS site, x, y FROM points),
tiles AS (SELECT vec_id AS tile, embedding[3]::DOUBLE AS x, embedding[4]::DOUBLE AS y,
          embedding[5]::DOUBLE AS feature_0, embedding[6]::DOUBLE AS feature_1 FROM embeddings)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def case_sql(pairs) -> str:
    return " ".join(f"WHEN {c} THEN {v}" for c, v in pairs)
