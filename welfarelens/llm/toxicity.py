"""Toxicity of documents by a bidirectional gated recurrent network over all overlapping windows."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from welfarelens.llm import gru
from welfarelens.llm.labelled import labelled_sample
from welfarelens.llm.tables import small_batches, stored
from welfarelens.llm.token_files import text_parts
from welfarelens.session import ship_package

#: Texts scored at once hold so many characters, except a longer single one.
SCORED_CHARS = 1 << 20


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = 1000, negatives: int = 2000, max_chars: int = 8000) -> gru.Network:
    """Fit on a bounded sample of labelled documents: see ``labelled_sample`` and ``gru.train``.

    The sample, at most ``positives + negatives`` texts of ``max_chars`` characters, is all the driver receives; of a
    longer text it is a piece of this size. Rows that repeat an id may each be chosen; empty tables give a network that
    gives all texts the same score, with a warning.
    """
    rows, _ = labelled_sample(docs, labels, label, {0: negatives, 1: positives}, max_chars)
    random.Random(0).shuffle(rows)
    return gru.train([t for t, _ in rows], np.array([y for _, y in rows], np.float32))


def toxicity_score(model: gru.Network, text: Column, spark) -> Column:
    """The probability of every whole text, from 0 to 1, as a column. A null text is an empty one."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = texts.tolist()
            scores = [shared.value.scores(texts[a:b]) for a, b in text_parts(texts, SCORED_CHARS)]
            yield pd.Series(np.concatenate([np.empty(0), *scores]))

    return score(text.cast("string"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; no shuffle, all columns stay, whatever their names.

    Every row is judged by its own text, also rows that repeat an id; null and empty texts score like any other. With
    no usable label all texts have the same score, see ``gru.train``. An empty table gives an empty one.
    """
    model = train_toxicity(docs, labels)
    spark = docs.sparkSession
    with small_batches(spark):
        return stored(docs.filter(toxicity_score(model, F.col("text"), spark) < threshold), "not-toxic")
