"""Metadata-driven projection and encoding of survey tables.

The metadata table has one row per variable. It is read on the driver: it
describes columns, so it is as long as the data is wide.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from welfarelens.operators.ordered import running_totals

ID_COLUMNS = ("hhid", "case_id", "hh_id", "hh_wgt")


def numeric_and_categorical(df: DataFrame, forced_suffix: str = "_nan") -> tuple[list[str], list[str]]:
    """Column names by type; dates in neither list, ``forced_suffix`` columns always categorical."""
    numeric, other = [], []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType) and not f.name.endswith(forced_suffix):
            numeric.append(f.name)
        elif not isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            other.append(f.name)
    return numeric, other


def drop_ids(df: DataFrame, ids: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Drop the id and weight columns that exist."""
    return df.drop(*ids)


def drop_fine_geography(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Drop geographic columns that are not marked as the coarser level."""
    fine = (
        metadata.filter(F.col("geographic_indicator") & ~F.coalesce("geographic_indicator_coarser", F.lit(False)))
        .select("variable_name")
        .collect()
    )
    return df.drop(*[r[0] for r in fine])


def expand_covariates(metadata: DataFrame, covariates: Sequence[str]) -> list[str]:
    """Physical columns of logical covariates, in the given order; unknown covariates are an error."""
    rows = metadata.filter(F.col("covariate").isin(list(covariates))).select("covariate", "columns").collect()
    known = {r["covariate"]: list(r["columns"]) for r in rows}
    missing = [c for c in covariates if c not in known]
    if missing:
        raise KeyError(f"covariates without metadata: {missing}")
    return [c for cov in covariates for c in known[cov]]


@dataclass
class CandidateRule:
    """Which covariates belong to a set: those of some modules, some more by name, and never some others."""

    modules: Sequence[str] = ()
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()


def candidate_sets(
    metadata: DataFrame, rules: Mapping[str, CandidateRule], excluded: Sequence[str] = (), complement: str | None = None
) -> dict[str, dict[str, list[str]]]:
    """Covariates and their physical columns of every named set, as predictor selection takes them.

    ``metadata`` has covariate, type, module and columns. Covariates of type ``dropped`` and those in ``excluded``
    belong to no set. A covariate belongs to a set if its module is one of the rule's or the rule includes it, unless
    the rule excludes it. ``complement`` names the set of all considered covariates that no rule has taken. A name or
    module that the metadata does not know is an error, and so is a covariate without columns.
    """
    rows = {r["covariate"]: r for r in metadata.select("covariate", "type", "module", "columns").collect()}
    modules = {r["module"] for r in rows.values()}
    named = [*excluded, *(c for r in rules.values() for c in [*r.include, *r.exclude])]
    unknown = sorted({c for c in named if c not in rows} | {m for r in rules.values() for m in r.modules if m not in modules})
    if unknown:
        raise KeyError(f"covariates or modules without metadata: {unknown}")
    considered = sorted(c for c, r in rows.items() if r["type"] != "dropped" and c not in set(excluded))
    out: dict[str, dict[str, list[str]]] = {}
    for name, rule in rules.items():
        taken = [c for c in considered if (rows[c]["module"] in rule.modules or c in rule.include) and c not in rule.exclude]
        out[name] = {c: list(rows[c]["columns"] or []) for c in taken}
    if complement is not None:
        rest = [c for c in considered if not any(c in s for s in out.values())]
        out[complement] = {c: list(rows[c]["columns"] or []) for c in rest}
    empty = sorted({c for s in out.values() for c, columns in s.items() if not columns})
    if empty:
        raise KeyError(f"covariates without columns: {empty}")
    return out


def select_covariates(
    df: DataFrame,
    metadata: DataFrame,
    covariates: Sequence[str],
    keep: Sequence[str],
    where: Column | None = None,
) -> DataFrame:
    """Covariate columns plus ``keep``, optionally only one district; an empty result is an error."""
    columns = expand_covariates(metadata, covariates)
    out = (df.filter(where) if where is not None else df).select(*columns, *keep)
    if out.isEmpty():
        raise ValueError("no rows left")
    return out


def categorical_columns(metadata: DataFrame, df: DataFrame) -> list[str]:
    """Columns of ``df`` that the metadata calls categorical (either metadata form)."""
    kind = "type" if "type" in metadata.columns else "data_type"
    name = "covariate" if "covariate" in metadata.columns else "variable_name"
    wanted = {r[0] for r in metadata.filter(F.col(kind) == "categorical").select(name).collect()}
    return [c for c in df.columns if c in wanted]


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows: the different non-NULL values of each column, as text."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    return df.select(cells.alias("c")).select("c.*").filter(F.col("value").isNotNull()).distinct()


def category_lists(df: DataFrame, columns: Sequence[str], limit: int = 5000) -> dict[str, list[str]]:
    """Sorted categories per column on the driver.

    They become columns of the encoded table, so their number must be a sensible
    table width: more than ``limit`` in all is an error, not a truncation.
    """
    if not columns:
        return {}
    rows = distinct_values(df, columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} categories; use sparse_one_hot instead")
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]], dtype: str = "float") -> DataFrame:
    """Replace each column by 0/1 columns ``<column>_<value>``; NULL is all zeros.

    Which columns are categorical comes from the caller (the metadata), not from
    their type, so categories stored as numbers are encoded too. One projection.
    """
    kept = [F.col(c) for c in df.columns if c not in categories]
    flags = [
        F.when(F.col(c).cast("string") == v, F.lit(1.0)).otherwise(F.lit(0.0)).cast(dtype).alias(f"{c}_{v}")
        for c, values in categories.items()
        for v in values
    ]
    return df.select(*kept, *flags)


def align_columns(df: DataFrame, columns: Sequence[str], fill: float = 0.0, dtype: str = "float") -> DataFrame:
    """Exactly ``columns`` in that order; missing ones are filled."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(fill).cast(dtype).alias(c) for c in columns])


def one_hot_pair(
    train: DataFrame, test: DataFrame, columns: Sequence[str], dtype: str = "float"
) -> tuple[DataFrame, DataFrame]:
    """One-hot both tables with the categories of either, so both have the same columns."""
    cats = category_lists(train.select(*columns).unionByName(test.select(*columns)), columns)
    return one_hot(train, cats, dtype), one_hot(test, cats, dtype)


def sparse_one_hot(df: DataFrame, columns: Sequence[str], out: str = "encoded") -> DataFrame:
    """One sparse vector of all indicator columns, for categories too many to be columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    index = StringIndexer(
        inputCols=list(columns), outputCols=[f"__i_{c}" for c in columns],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    )
    hot = OneHotEncoder(
        inputCols=[f"__i_{c}" for c in columns], outputCols=[f"__h_{c}" for c in columns], dropLast=True
    )
    join = VectorAssembler(inputCols=[f"__h_{c}" for c in columns], outputCol=out)
    model = Pipeline(stages=[index, hot, join]).fit(df)
    return model.transform(df).drop(*[f"__i_{c}" for c in columns], *[f"__h_{c}" for c in columns])


def inverse_one_hot(df: DataFrame, indicator_map: Mapping[str, tuple[str, str]], drop: bool = True) -> DataFrame:
    """Indicator columns back to one column per covariate.

    ``indicator_map`` maps a column to (covariate, category). The first indicator
    that is 1 wins; a row with none is NULL.
    """
    groups: dict[str, list[tuple[str, str]]] = {}
    for column, (covariate, category) in indicator_map.items():
        groups.setdefault(covariate, []).append((column, category))
    out = df.withColumns(
        {
            cov: F.coalesce(*[F.when(F.col(f"`{c}`") == 1, F.lit(v)) for c, v in members])
            for cov, members in groups.items()
        }
    )
    return out.drop(*indicator_map) if drop else out


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column as the 0-based rank of its value among the sorted categories; NULL is -1.

    Numbers are ranked as numbers, everything else as text. The categories are ranked and joined in Spark whatever
    their number; none come to the driver.
    """
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    texts = [c for c in columns if c not in numeric]
    ranks = category_ranks(df, texts) if texts else None
    coded = df
    for c in columns:
        if c in numeric:
            values = df.select(F.col(c).alias("__v")).distinct()
            totals = running_totals(values, "__v", {"n": F.sum(F.lit(1.0))})
            own = totals.select("__v", (F.col("cum_n") - 1).cast("int").alias("__c"))
            match = F.col(c) == F.col("__v")
        else:
            own = ranks.filter(F.col("column") == c).select(F.col("value").alias("__v"), F.col("code").alias("__c"))
            match = F.col(c).cast("string") == F.col("__v")
        coded = coded.join(own, match, "left").withColumn(c, F.coalesce("__c", F.lit(-1)).cast("int")).drop("__v", "__c")
    return coded.select(*df.columns)


def category_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): 0-based rank of every category of a column, without sorting a column in one task."""
    values = distinct_values(df, columns)
    ends = values.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    # six bytes after the prefix that all values of the column share, read as a number
    after = F.lit(1)
    for r in ends:
        shared = os.path.commonprefix([r["lo"].encode(), r["hi"].encode()])
        after = F.when(F.col("column") == r["column"], F.lit(len(shared) + 1)).otherwise(after)
    piece = F.encode("value", "UTF-8").substr(after, F.lit(6))
    key = F.conv(F.rpad(F.hex(piece), 12, "0"), 16, 10).cast("double")
    ranked = running_totals(values, "value", {"n": F.sum(F.lit(1.0))}, ["column"], order_key=key)
    return ranked.select("column", "value", (F.col("cum_n") - 1).cast("long").alias("code"))


def membership_matrix(
    pairs: DataFrame, row: str, item: str, limit: int = 2000
) -> DataFrame:
    """0/1 table of which row holds which item; one column per item."""
    items = [r[0] for r in pairs.select(item).filter(F.col(item).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(items) > limit:
        raise ValueError(f"more than {limit} items would become columns")
    return pairs.groupBy(row).agg(
        *[F.max(F.when(F.col(item) == i, 1).otherwise(0)).alias(str(i)) for i in sorted(items)]
    )


def item_frequency(pairs: DataFrame, item: str, descriptions: DataFrame, key: str) -> DataFrame:
    """How often each item occurs, with its description (NULL if it has none)."""
    counts = pairs.groupBy(item).agg(F.count(F.lit(1)).alias("count"))
    side = descriptions.withColumnRenamed(key, "__k")
    return counts.join(side, F.col(item) == F.col("__k"), "left").drop("__k")


def insert_after(df: DataFrame, after: str, name: str, value: Column) -> DataFrame:
    """Add a column right behind another one."""
    out = []
    for c in df.columns:
        out.append(F.col(c))
        if c == after:
            out.append(value.alias(name))
    return df.select(*out)
