"""Document quality by pairwise ranking: a Bradley-Terry model on features of the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from welfarelens.llm.labelled import known_labels, labelled_sample, texts_by_id
from welfarelens.llm.tables import stored
from welfarelens.llm.token_files import text_parts
from welfarelens.session import ship_package

#: Bytes whose shares are features, each group by itself.
BYTE_GROUPS = [b"|", b"#", b"$", b"%", b"&", b"*", b"!", b"?", b".", b",", b";:", b"\"'`", b"()[]{}<>", b"/\\", b"@", b"=+~^_", b"-", b"\n", b" ", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256))]
_GROUP_OF = np.full(256, len(BYTE_GROUPS), np.int64)
for _i, _g in enumerate(BYTE_GROUPS):
    _GROUP_OF[list(_g)] = _i
LENGTHS = 12
FEATURES = len(BYTE_GROUPS) + 1 + LENGTHS + 9


def text_features(text: str | None) -> np.ndarray:
    """Shares of byte groups, of word lengths, of repeats and of line shapes; all zero for an empty text."""
    data = (text or "").encode("utf-8", "replace")
    out = np.zeros(FEATURES)
    if not data:
        return out
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    groups = np.bincount(_GROUP_OF, weights=histogram, minlength=len(BYTE_GROUPS) + 1)
    out[: len(groups)] = np.sqrt(groups / len(data))
    words = data.split()
    if not words:
        return out
    n, at = len(words), len(groups)
    lengths = np.fromiter(map(len, words), np.int64, n)
    out[at : at + LENGTHS] = np.bincount(np.minimum(lengths, LENGTHS) - 1, minlength=LENGTHS)[:LENGTHS] / n
    different = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    out[at + LENGTHS :] = [
        np.log1p(n) / 10, np.log1p(lengths.mean()) / 3, lengths.std() / 10, np.sqrt(same / n), different / n,
        pairs / max(n - 1, 1), np.log1p(len(lines)) / 5, len(set(lines)) / len(lines), ends / len(lines),
    ]
    return out


class Ranker:
    """``score`` is a logistic curve through the learned document score that has 0.3 at the threshold."""

    def __init__(self, mean, scale, weights, threshold: float, cut: float):
        self.mean, self.scale, self.weights, self.threshold, self.cut = mean, scale, weights, threshold, cut

    def raw(self, features: np.ndarray) -> np.ndarray:
        return expanded((features - self.mean) / self.scale) @ self.weights

    def scores(self, texts) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        raw = self.raw(np.stack([text_features(t) for t in texts]))
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold + np.log(self.cut / (1 - self.cut)), -30, 30)))


def expanded(x: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, and their squares."""
    x = np.clip(x, -4, 4)
    return np.concatenate([x, x * x], axis=1)


def fit_ranker(features: np.ndarray, labels: np.ndarray, pairs: int = 60_000, steps: int = 300, decay: float = 1e-4, cut: float = 0.3, seed: int = 0) -> Ranker:
    """Bradley-Terry: the chance that document i is preferred to j is logistic in the difference of their scores.

    Preference pairs join a random document labelled 1 with a random one labelled 0. The weights minimise the logistic
    loss on feature differences. The threshold is the score quantile at which the share of documents below equals the
    share labelled 0. With one label only all scores equal that label's side.
    """
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = expanded((features - mean) / scale)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    weights = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return Ranker(mean, scale, weights, -1.0 if len(good) else 1.0, cut)
    rng = np.random.default_rng(seed)
    difference = (x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]).astype(np.float32)
    m, s = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        chance = 1 / (1 + np.exp(np.clip(difference @ weights.astype(np.float32), -30, 30)))  # of the wrong order
        g = -(difference.T @ chance) / pairs + decay * weights
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        weights -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Ranker(mean, scale, weights, float(np.quantile(x @ weights, len(bad) / len(labels))), cut)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 4000, max_chars: int = 20_000) -> Ranker:
    """Fit on a bounded sample of labelled documents, ``per_class`` of each label, see ``labelled_sample``.

    The threshold covers all labelled documents that are not held out, whole texts included: it is the quantile of
    their scores that equals the share of label 0. Null texts are empty ones, rows that repeat an id each count, and
    columns may have any names. Without any usable label all texts score on the cut, with one label only on its side.
    """
    rows, _ = labelled_sample(docs, labels, label, {0: per_class, 1: per_class}, max_chars)
    if not rows:
        return Ranker(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(2 * FEATURES), 0.0, 0.3)
    y = np.array([v for _, v in rows])
    model = fit_ranker(np.stack([text_features(t) for t, _ in rows]), y)
    if 0 < y.mean() < 1:
        # scores, not texts, are brought to the labels
        scored = texts_by_id(docs).select("__id", _raw(model, F.col("__text"), docs.sparkSession).alias("raw"))
        scored = stored(scored.join(known_labels(labels, label), "__id").select("raw", "__label"), "labelled-scores")
        model.threshold = quantile(scored, "raw", scored.filter("__label = 0").count())
    return model


#: Bins into which a range of scores is cut by one pass.
BINS = 4096


def quantile(scores: DataFrame, column: str, place: int) -> float:
    """The score with ``place`` scores below it (the greatest one if there are no more), by counts in bins of bins.

    Each pass cuts the bin that holds the score; the last one is narrower than a millionth of a millionth of the range.
    """
    low, high, rows = scores.agg(F.min(column), F.max(column), F.count(column)).first()
    place = min(place, rows - 1)
    for _ in range(4):
        if not low < high:
            break
        width = (high - low) / BINS
        bin_of = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        inside = scores.filter(F.col(column).between(low, high))
        counts = inside.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for r in sorted(counts.collect(), key=lambda r: r["bin"]):
            if place < r["n"]:
                low, high = r["lo"], r["hi"]
                break
            place -= r["n"]
    return low


def _raw(model: Ranker, text: Column, spark) -> Column:
    """The learned document score before the threshold."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = texts.tolist()
            parts = [shared.value.raw(np.stack([text_features(t) for t in texts[a:b]])) for a, b in text_parts(texts)]
            yield pd.Series(np.concatenate([np.empty(0), *parts]))

    return raw(text.cast("string"))


def quality_score(model: Ranker, text: Column, spark) -> Column:
    """The score of every text, from 0 to 1, as a column. A null text is an empty one; equal texts have equal scores."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = texts.tolist()
            parts = [shared.value.scores(texts[a:b]) for a, b in text_parts(texts)]
            yield pd.Series(np.concatenate([np.empty(0), *parts]))

    return score(text.cast("string"))
