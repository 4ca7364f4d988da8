"""Country by year series: latest values, lookups, gap filling, overrides, indices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from welfarelens.sources.readers import year_columns


# ---------------------------------------------------------------- latest values


def latest_row(df: DataFrame, entity: str, year: str, values: Sequence[str]) -> DataFrame:
    """Per entity and value: the value in the entity's last year, even if it is NULL there.

    If an entity never has the value, value and year are both NULL. Columns
    ``latest_<value>`` and ``latest_<value>_year``. Rows without an entity are dropped;
    an entity has one row per year.
    """
    aggs = []
    for v in values:
        seen = F.count(v) > 0
        aggs += [
            F.when(seen, F.max_by(v, year)).alias(f"latest_{v}"),
            F.when(seen, F.max(year)).alias(f"latest_{v}_year"),
        ]
    return df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(*aggs)


def latest_non_null(wide: DataFrame, out: str, years: Sequence[str] | None = None, scale: float = 1.0) -> DataFrame:
    """Last non-NULL year column of a wide table, as ``out`` and ``out_year``. Row by row, no shuffle."""
    years = list(years or year_columns(wide))[::-1]
    return wide.withColumns(
        {
            out: F.coalesce(*[F.col(f"`{y}`") for y in years]) * scale,
            f"{out}_year": F.coalesce(*[F.when(F.col(f"`{y}`").isNotNull(), F.lit(int(y))) for y in years]),
        }
    )


# ---------------------------------------------------------------- wide and long


def to_long(wide: DataFrame, ids: Sequence[str], value: str, year: str = "year") -> DataFrame:
    """Year columns to rows."""
    years = year_columns(wide)
    return wide.unpivot(list(ids), years, year, value).withColumn(year, F.col(year).cast("int"))


def at_year(year: str | Column, years: Sequence[str], source: str | None = None) -> Column:
    """Value of the year column that another column of the row names; NULL if there is none."""
    y = F.col(year) if isinstance(year, str) else year
    prefix = f"{source}." if source else ""
    out = F.lit(None).cast("double")
    for name in years:
        out = F.when(y == int(name), F.col(f"{prefix}`{name}`")).otherwise(out)
    return out


def lookup_year(
    df: DataFrame, key: str, year: str, wide: DataFrame, wide_key: str, out: str, scale: float = 1.0
) -> DataFrame:
    """Add the wide table's value at each row's own year. One join on the key, no long table."""
    years = year_columns(wide)
    values = F.struct(*[F.col(f"`{y}`").cast("double").alias(y) for y in years])
    joined = df.join(wide.select(F.col(wide_key).alias("__k"), values.alias("__years")), F.col(key) == F.col("__k"), "left")
    return joined.withColumn(out, at_year(year, years, "__years") * scale).drop("__k", "__years")


def value_at_fractional_year(year: str | Column, years: Sequence[str], last_resort: Mapping[int, int] | None = None) -> Column:
    """Series value at a year that may be fractional: linear between the two years around it.

    ``last_resort`` maps a missing whole year to the year used in its place.
    """
    y = (F.col(year) if isinstance(year, str) else year).cast("double")
    lower = F.floor(y)
    share = y - lower

    def whole(at: Column) -> Column:
        return at_year(at, years)

    for missing, used in (last_resort or {}).items():
        if str(missing) not in years:
            lower = F.when((lower == missing) & (share == 0), F.lit(used)).otherwise(lower)
    return F.when(share == 0, whole(lower)).otherwise(whole(lower) * (1 - share) + whole(lower + 1) * share)


# ---------------------------------------------------------------- estimates at a year


def estimate_at_year(
    queries: DataFrame,
    entity: str,
    at: str,
    series: DataFrame,
    series_entity: str,
    series_year: str,
    values: Sequence[str],
) -> DataFrame:
    """Series values at each query's year: exact, else interpolated, else the nearest year.

    Adds the value columns and ``method``. A row of the exact year is used even if
    its value is NULL; for the rest, rows without the first value are ignored. If a
    year is given twice, the row with the largest first value counts. The work is done once per different (entity, year), so repeated queries cost nothing.
    """
    pairs = queries.select(F.col(entity).alias("__e"), F.col(at).cast("int").alias("__t")).distinct()
    # one row per entity and year, so that an entity meets at most years x years rows
    first = F.col(values[0]).cast("double")
    data = (
        series.filter(F.col(series_entity).isNotNull())
        .groupBy(F.col(series_entity).alias("__se"), F.col(series_year).cast("int").alias("__y"))
        .agg(
            F.max(first).alias(f"__v_{values[0]}"),
            *[
                F.coalesce(F.max_by(F.col(v).cast("double"), first), F.max(F.col(v).cast("double"))).alias(f"__v_{v}")
                for v in values[1:]
            ],
        )
    )
    y, t = F.col("__y"), F.col("__t")
    usable = F.col(f"__v_{values[0]}").isNotNull()
    earlier, later = F.when((y < t) & usable, y), F.when((y > t) & usable, y)
    aggs = [F.count_if(y == t).alias("exact"), F.max(earlier).alias("yb"), F.min(later).alias("ya")]
    for v in values:
        x = F.col(f"__v_{v}")
        aggs += [
            F.max(F.when(y == t, x)).alias(f"__e_{v}"),
            F.max_by(x, earlier).alias(f"__b_{v}"),
            F.min_by(x, later).alias(f"__a_{v}"),
        ]
    found = pairs.join(data, F.col("__e") == F.col("__se"), "left").groupBy("__e", "__t").agg(*aggs)
    exact, yb, ya = F.col("exact") > 0, F.col("yb"), F.col("ya")
    share = (t - yb) / (ya - yb)

    def pick(v: str) -> Column:
        b, a = F.col(f"__b_{v}"), F.col(f"__a_{v}")
        return (
            F.when(exact, F.col(f"__e_{v}"))
            .when(yb.isNotNull() & ya.isNotNull(), b + share * (a - b))
            .when(yb.isNotNull(), b)
            .otherwise(a)
        )

    nearest = F.coalesce(yb, ya)
    method = (
        F.when(exact, F.lit("exact year"))
        .when(
            yb.isNotNull() & ya.isNotNull(),
            F.concat(F.lit("interpolated using "), yb.cast("string"), F.lit(" and "), ya.cast("string")),
        )
        .when(nearest.isNotNull(), F.concat(F.lit("from nearest year: "), nearest.cast("string")))
        .otherwise(F.lit("no data available"))
    )
    estimates = found.select("__e", "__t", *[pick(v).alias(v) for v in values], method.alias("method"))
    return (
        queries.join(
            estimates,
            F.col(entity).eqNullSafe(F.col("__e")) & F.col(at).cast("int").eqNullSafe(F.col("__t")),
            "left",
        )
        .drop("__e", "__t")
    )


# ---------------------------------------------------------------- filling and overriding


def impute_from(base: DataFrame, other: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Fill NULLs of ``base`` from a second source; ``columns`` maps base to other names.

    ``other`` has one row per key.
    """
    return _second_source(base, other, key, columns, override=False)


def override_from(base: DataFrame, other: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Replace values of ``base`` wherever the second source has one. Call again for a stronger source."""
    return _second_source(base, other, key, columns, override=True)


def _second_source(base, other, key, columns, override):
    side = other.select(F.col(key).alias("__k"), *[F.col(o).alias(f"__{b}") for b, o in columns.items()])
    joined = base.join(side, F.col(key) == F.col("__k"), "left")
    new = {
        b: F.coalesce(f"__{b}", b) if override else F.coalesce(b, f"__{b}") for b in columns
    }
    return joined.withColumns(new).drop("__k", *[f"__{b}" for b in columns])


def donor_copy(df: DataFrame, key: str, donors: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows listed in ``donors`` (target, donor) take the donor's values; NULL if the donor is missing."""
    given = df.select(F.col(key).alias("__donor_key"), *[F.col(c).alias(f"__d_{c}") for c in columns])
    source = donors.join(given, F.col("donor") == F.col("__donor_key"), "left").drop("donor", "__donor_key")
    joined = df.join(source, F.col(key) == F.col("target"), "left")
    return joined.withColumns(
        {c: F.when(F.col("target").isNotNull(), F.col(f"__d_{c}")).otherwise(F.col(c)) for c in columns}
    ).drop("target", *[f"__d_{c}" for c in columns])


def ratio_extrapolation(
    series: DataFrame, entity: str, name: str, year: str, value: str, rules: DataFrame
) -> DataFrame:
    """A at year t as (A_s / B_s) * B_t for every rule.

    ``rules`` has entity, series (A), base (B), from_year (s), to_year (t), one row
    each. Returns the rules with ``estimate``. One join and one aggregation.
    """
    r = rules.select(
        F.col("entity").alias("__e"), F.col("series").alias("__a"), F.col("base").alias("__b"),
        F.col("from_year").alias("__s"), F.col("to_year").alias("__t"),
    )
    s, t = F.col("__s"), F.col("__t")
    n, y, v = F.col(name), F.col(year), F.col(value)
    is_a, is_b = n == F.col("__a"), n == F.col("__b")
    used = r.join(
        series.select(entity, name, year, value),
        (F.col(entity) == F.col("__e")) & ((is_a & (y == s)) | (is_b & ((y == s) | (y == t)))),
        "left",
    )
    out = used.groupBy("__e", "__a", "__b", "__s", "__t").agg(
        F.max(F.when(is_a & (y == s), v)).alias("a_s"),
        F.max(F.when(is_b & (y == s), v)).alias("b_s"),
        F.max(F.when(is_b & (y == t), v)).alias("b_t"),
    )
    return out.select(
        F.col("__e").alias("entity"), F.col("__a").alias("series"), F.col("__b").alias("base"),
        s.alias("from_year"), t.alias("to_year"),
        (F.try_divide("a_s", "b_s") * F.col("b_t")).alias("estimate"),
    )


def index_to_base_year(
    df: DataFrame, year: str, value: str, base_year: int, by: Sequence[str] = (), out: str | None = None
) -> DataFrame:
    """Series divided by its value in the base year."""
    out = out or value
    base = df.filter(F.col(year) == base_year).groupBy(*by).agg(F.max(value).alias("__base"))
    if by:
        joined = df.join(base, list(by), "left")
    else:
        joined = df.crossJoin(F.broadcast(base))
    return joined.withColumn(out, F.try_divide(value, "__base")).drop("__base")


def year_spine(df: DataFrame, year: str, last: int) -> DataFrame:
    """All years from the earliest in ``df`` to ``last``."""
    return df.agg(F.min(year).cast("int").alias("y0")).select(
        F.explode(F.sequence(F.col("y0"), F.lit(last))).alias("year")
    )


def fill_between_and_ahead(df: DataFrame, entity: str, year: str, value: str) -> DataFrame:
    """Fill single missing years: mean of the two neighbours, or 2a - b after the last two years.

    Neighbours are the rows of the years y - 1, y + 1 and y - 2, not the adjacent
    rows. An entity has one row per year.
    """
    w = W.partitionBy(entity).orderBy(year)

    def at(step: int) -> Column:
        return F.max(value).over(w.rangeBetween(step, step))

    return df.withColumn(
        value, F.coalesce(F.col(value), (at(-1) + at(1)) / 2, 2 * at(-1) - at(-2))
    )


def share_of_total(df: DataFrame, totals: DataFrame, year: str, part: str | Column, total: str, out: str) -> DataFrame:
    """Each row's part of the total of its year."""
    side = totals.select(F.col(year).alias("__y"), F.col(total).alias("__total"))
    p = F.col(part) if isinstance(part, str) else part
    return (
        df.join(side, F.col(year) == F.col("__y"), "left")
        .withColumn(out, F.try_divide(p, F.col("__total")))
        .drop("__y", "__total")
    )


def times_reference(df: DataFrame, value: str, reference: DataFrame, factor: Column, out: str) -> DataFrame:
    """Multiply by one scalar taken from a reference table (``factor`` is an aggregate over it)."""
    one = reference.agg(factor.alias("__f"))
    return df.crossJoin(F.broadcast(one)).withColumn(out, F.col(value) * F.col("__f")).drop("__f")
