"""Checks of survey tables and their metadata."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

RTOL, ATOL = 1e-5, 1e-8


def is_close(a: str | Column, b: str | Column, rtol: float = RTOL, atol: float = ATOL) -> Column:
    """|a - b| <= atol + rtol |b|; NULL if either is NULL."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.abs(a - b) <= atol + rtol * F.abs(b)


# ---------------------------------------------------------------- metadata


def metadata_mismatch(df: DataFrame, metadata: DataFrame, name: str = "variable_name") -> DataFrame:
    """Names only in the metadata or only in the data: rows (variable_name, found_in)."""
    spark = df.sparkSession
    columns = spark.createDataFrame([(c,) for c in df.columns], "__c string")
    listed = metadata.select(F.col(name).alias("__n")).distinct()
    both = listed.join(columns, F.col("__n") == F.col("__c"), "full")
    return both.filter(F.col("__n").isNull() | F.col("__c").isNull()).select(
        F.coalesce("__n", "__c").alias("variable_name"),
        F.when(F.col("__n").isNotNull(), F.lit("metadata")).otherwise(F.lit("data")).alias("found_in"),
    )


def missing_indicator_audit(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Findings on missing-value indicators: rows (variable_name, finding).

    Indicators end in ``_missing`` or ``_m``.
    """
    indicators = [c for c in df.columns if c.endswith(("_missing", "_m"))]
    covered = [c.removesuffix("_missing") if c.endswith("_missing") else c.removesuffix("_m") for c in indicators]
    spark = df.sparkSession
    ind = spark.createDataFrame([(c,) for c in indicators], "variable_name string")
    unlisted = ind.join(metadata, "variable_name", "left_anti").withColumn(
        "finding", F.lit("indicator without metadata")
    )
    name = F.col("variable_name")
    categorical = metadata.filter((F.col("data_type") == "categorical") & name.isin(covered)).select(
        name, F.lit("categorical with indicator").alias("finding")
    )
    numeric = metadata.filter(
        (F.col("data_type") == "numeric") & ~name.isin(covered) & ~name.endswith("_missing") & ~name.endswith("_m")
    ).select(name, F.lit("numeric without indicator").alias("finding"))
    return unlisted.unionByName(categorical).unionByName(numeric)


# fixed values: words that make a variable worth a look
SUSPICIOUS = {
    "unit": r"unit",
    "consumption": r"consumption",
    "demographic": r"relig|ethn|nationality",
}


def suspicious_variables(metadata: DataFrame) -> DataFrame:
    """Variables whose name or description needs a look: rows (variable_name, finding)."""
    has_text = "variable_description" in metadata.columns
    name = F.col("variable_name")
    text = F.col("variable_description") if has_text else name
    parts = []
    for finding, pattern in SUSPICIOUS.items():
        hit = F.coalesce(name.rlike(pattern), F.lit(False)) | F.coalesce(text.rlike(pattern), F.lit(False))
        if finding == "unit":
            hit = hit & ~name.contains("community")
        parts.append(F.when(hit, F.lit(finding)))
    parts.append(F.when(name.rlike("(?i)id|code") & (F.col("data_type") == "numeric"), F.lit("numeric id or code")))
    return metadata.select(name, F.explode(F.array_compact(F.array(*parts))).alias("finding"))


def invalid_metadata(metadata: DataFrame) -> DataFrame:
    """Values outside the permitted domain: rows (variable_name, field, value)."""
    required = {"variable_name", "data_type", "geographic_indicator", "geographic_indicator_coarser"}
    missing = required - set(metadata.columns)
    if missing:
        raise ValueError(f"metadata lacks {sorted(missing)}")
    flags = [
        c for c in ("geographic_indicator", "geographic_indicator_coarser", "geographic_indicator_finer")
        if c in metadata.columns
    ]
    bad = [
        F.when(
            ~F.coalesce(F.col("data_type").isin("numeric", "categorical"), F.lit(False)),
            F.struct(F.lit("data_type").alias("field"), F.col("data_type").cast("string").alias("value")),
        )
    ]
    for c in flags:
        text = F.lower(F.col(c).cast("string"))
        bad.append(
            F.when(
                text.isNotNull() & ~text.isin("0", "1", "0.0", "1.0", "true", "false"),
                F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")),
            )
        )
    return metadata.select("variable_name", F.explode(F.array_compact(F.array(*bad))).alias("b")).select(
        "variable_name", "b.*"
    )


def require_valid_metadata(metadata: DataFrame) -> None:
    """Raise if any metadata value is not permitted, naming up to 20 of them."""
    bad = invalid_metadata(metadata).limit(20).collect()
    if bad:
        raise ValueError(f"invalid metadata: {[tuple(r) for r in bad]}")


def type_mismatches(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Declared against physical type: rows (variable_name, data_type, physical_type, severity)."""
    physical = [
        (f.name, f.dataType.simpleString(), isinstance(f.dataType, T.NumericType)) for f in df.schema.fields
    ]
    have = df.sparkSession.createDataFrame(
        physical, "variable_name string, physical_type string, is_numeric boolean"
    )
    name = F.col("variable_name")
    severity = (
        F.when((F.col("data_type") == "numeric") & ~F.col("is_numeric"), F.lit("error"))
        .when(
            (F.col("data_type") == "categorical") & F.col("is_numeric")
            & ~name.endswith("_missing") & ~name.endswith("_m"),
            F.lit("warning"),
        )
    )
    return (
        metadata.join(F.broadcast(have), "variable_name")
        .withColumn("severity", severity)
        .filter(F.col("severity").isNotNull())
        .select("variable_name", "data_type", "physical_type", "severity")
    )


# ---------------------------------------------------------------- household table


def survey_findings(
    df: DataFrame,
    outcome: str,
    weight: str,
    household_id: str | None = "hhid",
    household_size: str = "hh_size",
    household_weight: str = "hh_wgt",
) -> DataFrame:
    """Checks of the required columns: rows (check, failures). One scan plus the id check.

    A missing required column or one that is not numeric raises at once.
    """
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    for c in (outcome, weight):
        if c not in df.columns:
            raise ValueError(f"missing column {c}")
        if c not in numeric:
            raise ValueError(f"{c} is not numeric")
    checks = {"null_outcome": F.col(outcome).isNull(), "null_weight": F.col(weight).isNull()}
    if {household_size, household_weight} <= set(df.columns):
        product = F.col(household_size) * F.col(household_weight)
        checks["size_times_weight"] = ~F.coalesce(is_close(product, weight), F.lit(False))
    for c in (f"{weight}_missing", f"{outcome}_missing", f"{household_weight}_missing"):
        if c in df.columns:
            checks[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0
    row = df.agg(*[F.count_if(cond).alias(n) for n, cond in checks.items()])
    out = row.unpivot([], list(checks), "check", "failures")
    if household_id and household_id in df.columns:
        repeated = (
            df.groupBy(household_id).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("failures"))
            .select(F.lit("duplicate_id").alias("check"), "failures")
        )
        out = out.unionByName(repeated)
    return out


def null_and_empty_shares(df: DataFrame, top: int | None = None) -> DataFrame:
    """Share of NULLs and of empty strings per column: rows (column, null_share, empty_share). One scan.

    With ``top`` only the columns that lack most, by the sum of both shares, then by name.
    """
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    aggs = []
    for i, c in enumerate(df.columns):
        aggs.append(F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(f"n{i}"))
        empty = F.coalesce((F.col(f"`{c}`") == ""), F.lit(False)).cast("int") if c in text else F.lit(0)
        aggs.append(F.avg(empty).alias(f"e{i}"))
    row = df.agg(*aggs)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_share"), F.col(f"e{i}").alias("empty_share"))
            for i, c in enumerate(df.columns)
        ]
    )
    out = row.select(F.explode(cells).alias("c")).select("c.*")
    if top is None:
        return out
    return out.orderBy((F.col("null_share") + F.col("empty_share")).desc(), "column").limit(top)


def cardinalities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of different non-NULL values per column: rows (column, distinct_values)."""
    from welfarelens.operators.encode import distinct_values

    counts = distinct_values(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(counts, "column", "left").select(
        "column", F.coalesce("n", F.lit(0)).cast("long").alias("distinct_values")
    )


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per value, NULLs left out."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("count"))


def group_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group, NULL keys left out."""
    return df.dropna(subset=list(by)).groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def group_distinct(df: DataFrame, group: str, value: str) -> DataFrame:
    """Different non-NULL values per group. Two plain aggregations, so a hot group is combined first."""
    pairs = df.filter(F.col(group).isNotNull()).groupBy(group, value).agg(F.lit(1).alias("one"))
    return pairs.groupBy(group).agg(F.count(value).alias("distinct_values"))


def group_first(df: DataFrame, group: str, values: Sequence[str], order: str) -> DataFrame:
    """First non-NULL value of each column per group, in ``order``."""
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        *[F.min_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    )


def group_mode(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """Most frequent non-NULL value of each column per group, the lowest on ties.

    Values are counted first, so a large group never sits in one aggregation buffer.
    """
    out = None
    for v in values:
        counts = df.filter(F.col(group).isNotNull() & F.col(v).isNotNull()).groupBy(group, v).agg(
            F.count(F.lit(1)).alias("__n")
        )
        top = counts.groupBy(group).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(v).alias("v")))["v"].alias(v))
        out = top if out is None else out.join(top, group, "full")
    return out


def stratum_feasibility(df: DataFrame, stratum: str, weight: str) -> DataFrame:
    """Per stratum: rows and number of different weights."""
    cells = df.filter(F.col(stratum).isNotNull()).groupBy(stratum, weight).agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy(stratum).agg(
        F.sum("n").alias("count"), F.count(weight).alias("weights"),
    )


def stratum_weight_cells(df: DataFrame, stratum: str, weight: str) -> DataFrame:
    """Rows per stratum and weight."""
    return group_sizes(df, [weight, stratum])


# ---------------------------------------------------------------- comparisons


def rate_discrepancies(
    df: DataFrame, survey_rate: str, published_rate: str, threshold: float = 0.04
) -> DataFrame:
    """Survey minus published rate, its size, and whether it reaches the threshold."""
    diff = F.col(survey_rate) - F.col(published_rate)
    return df.withColumns(
        {
            "discrepancy": diff,
            "abs_discrepancy": F.abs(diff),
            "over_threshold": F.coalesce(F.abs(diff) >= threshold, F.lit(False)),
        }
    )


def changed_rows(new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value is new, gone or not close to the old one; NULL equals NULL, also as key."""
    a = new.select(F.col(key).alias("__a"), F.col(value).alias(f"{value}_new"))
    b = old.select(F.col(key).alias("__b"), F.col(value).alias(f"{value}_old"))
    n, o = F.col(f"{value}_new"), F.col(f"{value}_old")
    same = F.when(n.isNull() & o.isNull(), F.lit(True)).otherwise(F.coalesce(is_close(n, o), F.lit(False)))
    return (
        a.join(b, F.col("__a").eqNullSafe(F.col("__b")), "full")
        .filter(~same)
        .select(F.coalesce("__a", "__b").alias(key), n, o)
    )


def agreement_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows in which two columns agree, NULL agreeing with NULL."""
    return df.agg(F.avg(F.col(a).eqNullSafe(F.col(b)).cast("int")).alias("agreement"))


def split_integrity(full: DataFrame, *parts: DataFrame) -> bool:
    """Whether the parts have as many rows as the whole."""
    return full.count() == sum(p.count() for p in parts)


# ---------------------------------------------------------------- equivalent columns


#: Rows that may refute a relation between two columns before all rows are measured.
REFUTING_ROWS = 256


def _numeric_pairs(rows, names: Sequence[str], tolerance: float, total: int) -> Iterator[tuple[str, str]]:
    """Pairs of number columns that may be nearly identical or proportional, given a few of the ``total`` rows.

    One column at a time is compared with all later ones, as matrices; NULLs refute nothing.
    """
    x = rows[list(names)].to_numpy(dtype=float, na_value=np.nan)
    for i in range(len(names) - 1):
        a, rest = x[:, i : i + 1], x[:, i + 1 :]
        with np.errstate(all="ignore"):
            near = ~(np.abs(a - rest) > tolerance + tolerance * np.abs(rest)).any(axis=0)
            zero = ((a == 0) | (rest == 0)) & ~np.isnan(a) & ~np.isnan(rest)
            ratio = np.where(zero, np.nan, rest / a)
            # two ratios this far apart alone give all rows' ratios a deviation above the tolerance
            spread = np.fmax.reduce(ratio, axis=0) - np.fmin.reduce(ratio, axis=0)
            far = spread**2 / (2 * max(total - 1, 1)) >= tolerance**2
        for k in np.flatnonzero(near | (~(zero & (a != rest)).any(axis=0) & ~far)):
            yield names[i], names[i + 1 + k]


def _coded_pairs(rows, names: Sequence[str]) -> Iterator[tuple[str, str]]:
    """Pairs of columns that may be one to one, given a few rows: equal values of one go with equal values of the other.

    Columns without a NULL are named by the places where their values appear first, so only equal names are paired.
    """
    codes = np.stack([pd.factorize(rows[c])[0] for c in names], axis=1) if names else np.zeros((0, 0), int)
    whole = [i for i in range(len(names)) if (codes[:, i] >= 0).all()]
    alike: dict[bytes, list[int]] = {}
    for i in whole:
        alike.setdefault(codes[:, i].tobytes(), []).append(i)
    for group in alike.values():
        yield from ((names[i], names[k]) for i, k in itertools.combinations(group, 2))
    known = set(whole)
    for i in range(len(names)):
        others = np.array([k for k in range(len(names)) if (k > i if i not in known else k not in known and k > i)], int)
        if i in known and not len(others):
            continue
        a, b = codes[:, i : i + 1], codes[:, others]
        valid = (a >= 0) & (b >= 0)

        def different(values):
            values = np.sort(np.where(valid, values, -1), axis=0)
            return (values[0] >= 0).astype(int) + ((values[1:] != values[:-1]) & (values[1:] >= 0)).sum(axis=0)

        together = different(a * (len(codes) + 1) + b)
        for k in others[(together == different(a + np.zeros_like(b))) & (together == different(b))]:
            yield names[i], names[k]


def equivalent_columns(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    tolerance: float = 1e-6,
    max_categories: int = 100,
    batch: int = 150,
) -> DataFrame:
    """Pairs of columns with the same information: rows (column_a, column_b, relation, factor).

    Relations: ``constant`` (one column), ``identical``, ``nearly_identical``,
    ``proportional`` (zeros match, more than 10 rows without a zero, ratio b/a
    constant) and ``one_to_one`` (at most ``max_categories`` values each). A pair is
    reported once, under the first that holds. Columns named ``*_missing`` or ``*_m``
    are left out. A few rows refute nearly every pair for certain, by matrices and by
    names of the places of equal values; the pairs they leave are measured ``batch`` to a
    scan, each by plain aggregates, so most tables are scanned twice.
    """
    spark = df.sparkSession
    usable = [c for c in [*numeric, *categorical] if not c.endswith(("_missing", "_m"))]
    if not usable:
        return spark.createDataFrame([], "column_a string, column_b string, relation string, factor double")
    ends = df.agg(
        *[F.min(c).eqNullSafe(F.max(c)).alias(f"k{i}") for i, c in enumerate(usable)],
        *[F.approx_count_distinct(c, 0.02).alias(f"d{i}") for i, c in enumerate(usable)],
        F.count(F.lit(1)).alias("rows"),
    ).first()
    found: list[tuple] = []
    varying, few = [], set()
    for i, c in enumerate(usable):
        if ends[f"k{i}"]:
            found.append((c, None, "constant", None))
            continue
        varying.append(c)
        # far above the limit is surely too many; near it the exact sets below decide
        if ends[f"d{i}"] <= max_categories * 1.5:
            few.add(c)
    nums = [c for c in numeric if c in varying]
    order = [c for c in categorical if c in varying] + nums
    rows = df.select(*order).limit(REFUTING_ROWS).toPandas() if order else None
    numbers = set(nums)
    pairs = {p: True for p in _numeric_pairs(rows, nums, tolerance, ends["rows"])} if nums else {}
    for a, b in _coded_pairs(rows, [c for c in order if c in few]) if order else ():
        pairs.setdefault((a, b), a in numbers and b in numbers)
    places = {c: i for i, c in enumerate(order)}
    pairs = [(a, b, both) for (a, b), both in sorted(pairs.items(), key=lambda p: (not p[1], places[p[0][0]], places[p[0][1]]))]
    for start in range(0, len(pairs), batch):
        part = pairs[start : start + batch]
        aggs, sets = [], []
        for i, (a, b, both_numeric) in enumerate(part):
            x, y = F.col(a), F.col(b)
            valid = x.isNotNull() & y.isNotNull()
            if both_numeric:
                close = F.abs(x - y) <= tolerance + tolerance * F.abs(y)
                zero = (x == 0) | (y == 0)
                ratio = F.when(valid & ~zero, F.try_divide(y, x))
                aggs += [
                    F.coalesce(F.bool_and(x.eqNullSafe(y)), F.lit(True)).alias(f"same{i}"),
                    F.coalesce(F.bool_and(F.when(valid, close)), F.lit(True)).alias(f"near{i}"),
                    F.coalesce(F.bool_and(F.when(valid & zero, x == y)), F.lit(True)).alias(f"zero{i}"),
                    F.count(ratio).alias(f"n{i}"),
                    F.stddev_samp(ratio).alias(f"std{i}"),
                    F.avg(ratio).alias(f"mean{i}"),
                ]
            if a in few and b in few:
                # sets of at most a few hundred values, and of their pairs
                sets += [
                    F.size(F.collect_set(x)).alias(f"a{i}"),
                    F.size(F.collect_set(y)).alias(f"b{i}"),
                    F.size(F.collect_set(F.when(valid, F.struct(x.alias("x"), y.alias("y"))))).alias(f"ab{i}"),
                    F.size(F.collect_set(F.when(valid, x))).alias(f"va{i}"),
                    F.size(F.collect_set(F.when(valid, y))).alias(f"vb{i}"),
                ]
        # apart from each other, so that the plain sums keep their compiled code
        row = {}
        for group in (aggs, sets):
            if group:
                row |= df.agg(*group).first().asDict()
        for i, (a, b, both_numeric) in enumerate(part):
            if both_numeric and row[f"same{i}"]:
                found.append((a, b, "identical", None))
            elif both_numeric and row[f"near{i}"]:
                found.append((a, b, "nearly_identical", None))
            elif (
                both_numeric and row[f"n{i}"] > 10 and row[f"zero{i}"] and (row[f"std{i}"] or 0.0) < tolerance
            ):
                found.append((a, b, "proportional", row[f"mean{i}"]))
            elif f"ab{i}" in row:
                counts = {row[f"{k}{i}"] for k in ("a", "b", "ab", "va", "vb")}
                if len(counts) == 1 and counts.pop() <= max_categories:
                    found.append((a, b, "one_to_one", None))
    return spark.createDataFrame(found, "column_a string, column_b string, relation string, factor double")
