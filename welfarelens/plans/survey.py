"""From a household survey and its metadata to aligned training, validation and test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from welfarelens.operators import encode as E, split as S


@dataclass
class Datasets:
    train: DataFrame
    validation: DataFrame
    test: DataFrame
    test_covariates: DataFrame
    covariates: list[str]


def prepare_datasets(
    train: DataFrame,
    test: DataFrame,
    metadata: DataFrame,
    outcome: str,
    weight: str,
    id_column: str = "hhid",
    train_fraction: float = 0.8,
    seed: int = 1234,
    coarse_geography: bool = True,
) -> Datasets:
    """Drop fine geography and ids, one-hot the categoricals over both parts, align, cast to float, split.

    The id orders the split and is dropped afterwards.
    """
    other_ids = [c for c in E.ID_COLUMNS if c not in (id_column, weight)]

    def clean(df: DataFrame) -> DataFrame:
        df = E.drop_fine_geography(df, metadata) if coarse_geography else df
        return E.drop_ids(df, other_ids)

    a, b = clean(train), clean(test)
    categorical = [c for c in E.categorical_columns(metadata, a) if c not in (id_column, outcome, weight)]
    a, b = E.one_hot_pair(a, b, categorical)
    columns = [c for c in a.columns if c != id_column] + [c for c in b.columns if c not in a.columns]

    def as_float(df: DataFrame) -> DataFrame:
        aligned = E.align_columns(df, [id_column, *columns])
        return aligned.select(id_column, *[F.col(f"`{c}`").cast("float").alias(c) for c in columns])

    a, b = as_float(a), as_float(b).drop(id_column)
    marked = S.stratified_split(a, id_column, train_fraction, seed)
    return Datasets(
        train=marked.filter(F.col("split") == "train").drop("split", id_column),
        validation=marked.filter(F.col("split") == "test").drop("split", id_column),
        test=b,
        test_covariates=b.drop(outcome),
        covariates=[c for c in columns if c not in (outcome, weight)],
    )
