"""Sinks: folders of part files, written by the tasks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def write_csv_dated(df: DataFrame, folder: str, name: str, day: dt.date | None = None) -> str:
    """Write ``<folder>/<name>_<yyyymmdd>.csv`` and return the path."""
    stamp = (day or dt.date.today()).strftime("%Y%m%d")
    path = f"{folder}/{name}_{stamp}.csv"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_result(df: DataFrame, path: str, **labels) -> None:
    """Append result rows with run labels. Columns are stored by name, so key sets may differ."""
    tagged = df.withColumns({k: F.lit(v) for k, v in labels.items()}) if labels else df
    tagged.write.mode("append").parquet(path)


def rewrite_without(df: DataFrame, drop: Column, path: str) -> None:
    """Write the rows that do not match ``drop`` to a new path (a NULL match is kept)."""
    df.filter(~F.coalesce(drop, F.lit(False))).write.mode("errorifexists").parquet(path)


def key_value(df: DataFrame, scalars: Mapping[str, Column], key: str = "indicator", value: str = "value") -> DataFrame:
    """Aggregate ``scalars`` over ``df`` and return them as (key, value) rows."""
    row = df.agg(*[c.cast("double").alias(n) for n, c in scalars.items()])
    return row.unpivot([], list(scalars), key, value)
