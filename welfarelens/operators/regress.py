"""Weighted regression from cross-products, predictor selection, and cross-validated learners.

A least-squares fit needs only sums of products. They are collected per fold in
one pass over the data; the fit on any subset of columns, on their principal
components and for any choice of training folds is then small-matrix algebra.
Columns are standardised with a rough mean and deviation first, so the sums do not
cancel; if the sums show that they still do, a second pass uses the exact ones.

Rows with a NULL or NaN in any used column are left out of a fit; every fit says how
many rows there were and how many were complete.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from welfarelens.operators.ordered import join_groups
from welfarelens.session import ship_package, written_once

MAX_COLUMNS = 5000
NARROW = 14


@dataclass
class Moments:
    """Weighted sums of products of (1, columns..., outcome) per fold, in standardised units.

    ``plain`` holds the same sums without weights, where they were asked for.
    """

    columns: list[str]
    folds: list[int]
    matrices: dict[int, np.ndarray]
    center: np.ndarray
    scale: np.ndarray
    plain: dict[int, np.ndarray] | None = None
    rows: int = 0
    complete: int = 0

    def total(self) -> np.ndarray:
        return sum(self.matrices.values())

    def counts(self) -> dict[str, int]:
        """All rows, and those without a NULL in any used column."""
        return {"rows": self.rows, "complete": self.complete}

    def pick(self, columns: Sequence[str], outcome: str, folds: Sequence[int] | None = None) -> "Moments":
        """The moments of some of the columns, one of which is the outcome, and of some folds."""
        at = np.array([0, *self.index(columns), *(self.index([outcome]) if outcome in self.columns else [len(self.columns) + 1])])
        folds = self.folds if folds is None else list(folds)

        def cut(m: Mapping[int, np.ndarray] | None):
            return None if m is None else {f: m[f][np.ix_(at, at)] for f in folds}

        return Moments(
            list(columns), folds, cut(self.matrices), self.center[at[1:] - 1], self.scale[at[1:] - 1], cut(self.plain),
            self.rows, self.complete,
        )

    def index(self, columns: Iterable[str]) -> list[int]:
        place = {c: i + 1 for i, c in enumerate(self.columns)}
        return [place[c] for c in columns]


def cross_products(
    df: DataFrame, columns: Sequence[str], outcome: str, weight: str | None = None, fold: str | None = None,
    also_plain: bool = False,
) -> Moments:
    """All sums of products, by fold. Rows with a NULL in any used column are left out.

    Narrow tables are summed by plain aggregates. Wide ones go through Arrow once:
    each task adds up its own rows' matrix, and Spark adds the matrices row by row.
    """
    columns = list(columns)
    fold_column = F.col(fold).cast("int") if fold else F.lit(0)
    return _moments(df, columns, outcome, weight, fold_column, also_plain)


def _moments(
    df: DataFrame, columns: list[str], outcome: str, weight: str | None, fold: Column, also_plain: bool, copies: int = 1
) -> Moments:
    """``fold`` may be an array of ``copies`` numbers: the row then counts in each of these folds."""
    if len(columns) > MAX_COLUMNS:
        raise ValueError(f"{len(columns)} columns; the matrices must fit the driver (at most {MAX_COLUMNS})")
    names = [*columns, outcome]
    p = len(names)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    raw = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names)], w.alias("w"), fold.alias("fold"))
    ok = F.col("fold").isNotNull()
    for c in [*(f"x{i}" for i in range(p)), "w"]:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    raw = raw.withColumn("ok", ok)
    # from a few rows; the sums tell whether they were typical
    few = raw.filter("ok").limit(SAMPLE).agg(
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(p)]
    ).first()
    if few["m0"] is None:
        raise ValueError("no complete rows")
    center = np.array([few[f"m{i}"] for i in range(p)])
    scale = np.array([few[f"s{i}"] or 1.0 for i in range(p)])
    both = also_plain and weight is not None
    for _ in range(2):
        zero = F.lit(0.0)
        standard = raw.select(
            (F.explode("fold") if copies > 1 else F.col("fold")).alias("fold"),
            F.when(F.col("ok"), F.col("w")).otherwise(zero).alias("w"), F.col("ok").cast("double").alias("u"),
            *[F.when(F.col("ok"), (F.col(f"x{i}") - float(center[i])) / float(scale[i])).otherwise(zero).alias(f"x{i}") for i in range(p)],
        )
        rows, weighted, plain = (_narrow_sums if p <= NARROW else _wide_sums)(standard, p, both or weight is None)
        counts = sum(plain.values())
        mean = counts[0, 1:] / counts[0, 0]
        deviation = np.sqrt(np.maximum(np.diag(counts)[1:] / counts[0, 0] - mean**2, 0.0))
        if (np.abs(mean) <= TYPICAL * np.maximum(deviation, 1e-3)).all() and (deviation < TYPICAL).all():
            break
        center, scale = center + mean * scale, np.where(deviation > 0, deviation, 1.0) * scale
    if not also_plain:
        plain = None
    return Moments(
        columns, sorted(weighted), weighted, center, scale, plain, rows // copies, int(round(counts[0, 0])) // copies
    )


def fold_moments(
    df: DataFrame, columns: Sequence[str], outcome: str, weight: str | None, folds: Sequence[Column]
) -> Moments:
    """Moments of rows that count in several folds at once, one for each way of cutting the data."""
    numbers = F.array(*[f.cast("int") for f in folds]) if len(folds) > 1 else folds[0].cast("int")
    return _moments(df, list(columns), outcome, weight, numbers, True, len(folds))


#: Rows that give a rough mean and deviation, and how many deviations the mean may then be off.
SAMPLE, TYPICAL = 2000, 1e3


#: Matrix cells a task gathers before it hands its partial sums on.
TASK_CELLS = 4_000_000


def cross_products_by_group(
    df: DataFrame, group: str, columns: Sequence[str], outcome: str, weight: str, fold: str
) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(``group``, ``fold``, ``sums``) partial sums of products, and the center and scale of all rows.

    A group's matrices are the sums of its rows' arrays; each task adds up its own rows first, so a large group gives
    one row per task and fold. Rows without a group or with a NULL in any used column are left out.
    """
    columns = list(columns)
    names, p = [*columns, outcome], len(columns) + 1
    used = df.filter(F.col(group).isNotNull()).select(
        F.col(group), *[F.col(f"`{c}`").cast("double").alias(f"__x{i}") for i, c in enumerate(names)],
        F.col(weight).cast("double").alias("__w"), F.col(fold).cast("int").alias("__fold"),
    ).dropna()
    stats = used.agg(
        *[F.avg(f"__x{i}").alias(f"m{i}") for i in range(p)], *[F.stddev_pop(f"__x{i}").alias(f"s{i}") for i in range(p)]
    ).first()
    if stats["m0"] is None:
        raise ValueError("no complete rows")
    center = np.array([stats[f"m{i}"] for i in range(p)])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(p)])

    def add(batches):
        sums: dict = {}

        def out():
            keys = list(sums)
            frame = pd.DataFrame({group: [k for k, _ in keys], "fold": [f for _, f in keys], "sums": [sums[k].ravel() for k in keys]})
            sums.clear()
            return frame

        for rows in batches:
            x = (rows[[f"__x{i}" for i in range(p)]].to_numpy() - center) / scale
            z, w = np.column_stack([np.ones(len(x)), x]), rows["__w"].to_numpy()
            for key, at in rows.groupby([group, "__fold"]).indices.items():
                part = z[at]
                sums[key] = sums.get(key, 0.0) + part.T @ (part * w[at, None])
            if len(sums) * (p + 1) ** 2 > TASK_CELLS:
                yield out()
        if sums:
            yield out()

    kind = df.schema[group].dataType.simpleString()
    return used.mapInPandas(add, f"`{group}` {kind}, fold int, sums array<double>"), center, scale


Matrices = dict[int, np.ndarray]


def _narrow_sums(df: DataFrame, p: int, both: bool) -> tuple[int, Matrices, Matrices]:
    """Rows, weighted sums and plain ones; without ``both`` of the latter only the sums and the sums of squares."""
    term = [F.col("u")] + [F.col(f"x{i}") for i in range(p)]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    kinds = {"s": (F.col("w"), pairs), "u": (F.lit(1.0), [(i, j) for i, j in pairs if both or i == 0 or i == j])}
    rows = df.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("u").alias("complete"),
        *[F.sum(w * term[i] * term[j]).alias(f"{k}{i}_{j}") for k, (w, cells) in kinds.items() for i, j in cells],
    ).collect()
    out: dict[str, Matrices] = {k: {} for k in kinds}
    for r in rows:
        if not r["complete"]:
            continue
        for k, (_, cells) in kinds.items():
            m = np.zeros((p + 1, p + 1))
            for i, j in cells:
                m[i, j] = m[j, i] = r[f"{k}{i}_{j}"]
            out[k][r["fold"]] = m
    return sum(r["rows"] for r in rows), out["s"], out["u"]


def _wide_sums(df: DataFrame, p: int, both: bool) -> tuple[int, Matrices, Matrices]:
    """As ``_narrow_sums``."""
    names = ["u", *(f"x{i}" for i in range(p))]

    def partial(batches):
        sums: dict[tuple[int, bool], np.ndarray] = {}
        rows = 0
        for batch in batches:
            rows += len(batch)
            for key, part in batch[batch["u"] > 0].groupby("fold"):
                x = part[names].to_numpy()
                for plain in (False, True):
                    if plain and not both:
                        m = np.diag((x * x).sum(axis=0))
                        m[0] = x.sum(axis=0)
                    else:
                        m = (x if plain else x * part["w"].to_numpy()[:, None]).T @ x
                    at = (int(key), plain)
                    sums[at] = sums[at] + m if at in sums else m
        if rows:
            yield pd.DataFrame({"fold": [0], "plain": [False], "i": [-1], "values": [[float(rows)]]})
        for (key, plain), m in sums.items():
            for start in range(0, p + 1, 256):
                stop = min(start + 256, p + 1)
                yield pd.DataFrame(
                    {"fold": key, "plain": plain, "i": range(start, stop), "values": [list(v) for v in m[start:stop]]}
                )

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    parts = df.mapInPandas(partial, "fold int, plain boolean, i int, values array<double>")
    summed = (
        parts.select("fold", "plain", "i", array_to_vector("values").alias("v"))
        .groupBy("fold", "plain", "i")
        .agg(Summarizer.sum(F.col("v")).alias("v"))
        .select("fold", "plain", "i", vector_to_array("v").alias("v"))
    )
    out: dict[bool, Matrices] = {False: {}, True: {}}
    rows = 0
    for r in summed.toLocalIterator():
        if r["i"] < 0:
            rows = int(r["v"][0])
        else:
            out[r["plain"]].setdefault(r["fold"], np.zeros((p + 1, p + 1)))[r["i"]] = r["v"]
    return rows, out[False], out[True]


def solve(m: np.ndarray, idx: Sequence[int]) -> np.ndarray:
    """Least-squares coefficients (intercept first) of the last column on columns ``idx``; minimum norm if singular."""
    use = [0, *idx]
    a, b = m[np.ix_(use, use)], m[use, -1]
    return np.linalg.lstsq(a, b, rcond=1e-12)[0]


def score(m: np.ndarray, idx: Sequence[int], coef: np.ndarray) -> tuple[float, float]:
    """Weighted mean squared error and R2 of given coefficients on the rows summed in ``m``."""
    use = [0, *idx]
    n = m[0, 0]
    yy, y = m[-1, -1], m[0, -1]
    sse = yy - 2 * coef @ m[use, -1] + coef @ m[np.ix_(use, use)] @ coef
    sst = yy - y * y / n
    return max(sse, 0.0) / n, (1 - sse / sst) if sst > 0 else float("nan")


@dataclass
class Fit:
    """A weighted least-squares fit in the units of the data."""

    columns: list[str]
    intercept: float
    coefficients: list[float]
    mse: float
    r2: float
    rows: int = 0
    complete: int = 0

    def predict(self):
        """Prediction as a column expression."""
        out = F.lit(self.intercept)
        for c, b in zip(self.columns, self.coefficients):
            out = out + F.col(f"`{c}`") * F.lit(b)
        return out


def weighted_least_squares(df: DataFrame, columns: Sequence[str], outcome: str, weight: str | None = None) -> Fit:
    """Weighted linear regression with intercept; in-sample weighted MSE and R2."""
    mo = cross_products(df, columns, outcome, weight)
    m, idx = mo.total(), mo.index(columns)
    coef = solve(m, idx)
    mse, r2 = score(m, idx, coef)
    sy = mo.scale[-1]
    slopes = [coef[k + 1] * sy / mo.scale[i - 1] for k, i in enumerate(idx)]
    intercept = mo.center[-1] + coef[0] * sy - sum(b * mo.center[i - 1] for b, i in zip(slopes, idx))
    return Fit(list(columns), float(intercept), [float(b) for b in slopes], float(mse * sy**2), float(r2), mo.rows, mo.complete)


def check_leakage(df: DataFrame, columns: Sequence[str], outcome: str, weight: str, limit: float = 0.9) -> float:
    """In-sample weighted R2; above ``limit`` it is an error, because a covariate then holds the outcome."""
    r2 = weighted_least_squares(df, columns, outcome, weight).r2
    if r2 > limit:
        raise ValueError(f"in-sample weighted R2 is {r2:.4f}, check for leakage")
    return r2


def univariate_r2(df: DataFrame, columns: Sequence[str], outcome: str, weight: str | None = None) -> DataFrame:
    """In-sample weighted R2 of the outcome on each single column: rows (covariate, r2). One scan.

    A constant column explains nothing and gets 0.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    y = F.col(outcome)
    base = df.agg(F.avg(outcome).alias("y"), *[F.avg(c).alias(f"x{i}") for i, c in enumerate(columns)])
    shifted = df.crossJoin(F.broadcast(base.toDF("__y", *[f"__x{i}" for i in range(len(columns))])))
    yy = y - F.col("__y")
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c) - F.col(f"__x{i}")
        ok = F.col(c).isNotNull() & y.isNotNull() & w.isNotNull()
        for name, term in (("n", F.lit(1.0)), ("x", x), ("y", yy), ("xx", x * x), ("xy", x * yy), ("yy", yy * yy)):
            aggs.append(F.sum(F.when(ok, w * term)).alias(f"{name}{i}"))
    row = shifted.agg(*aggs)
    cells = []
    for i, c in enumerate(columns):
        n, sx, sy = F.col(f"n{i}"), F.col(f"x{i}"), F.col(f"y{i}")
        vx = F.col(f"xx{i}") - sx * sx / n
        vy = F.col(f"yy{i}") - sy * sy / n
        cxy = F.col(f"xy{i}") - sx * sy / n
        r2 = F.when(vx > 1e-12 * F.abs(F.col(f"xx{i}")), F.try_divide(cxy * cxy, vx * vy)).otherwise(F.lit(0.0))
        cells.append(F.struct(F.lit(c).alias("covariate"), r2.alias("r2")))
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def cross_validated_r2(
    df: DataFrame, columns: Sequence[str], outcome: str, fold: str, weight: str | None = None
) -> dict[str, float]:
    """Mean train and test R2 over folds; the fit is weighted, the scores are not."""
    mo = cross_products(df, columns, outcome, weight, fold, also_plain=True)
    return r2_by_folds(mo) | mo.counts()


def r2_by_folds(mo: Moments) -> dict[str, float]:
    """Mean train and test R2 of fits on all columns of the moments."""
    idx = mo.index(mo.columns)
    whole, plain_whole = mo.total(), sum(mo.plain.values())
    train, test = [], []
    for f in mo.folds:
        coef = solve(whole - mo.matrices[f], idx)
        test.append(score(mo.plain[f], idx, coef)[1])
        train.append(score(plain_whole - mo.plain[f], idx, coef)[1])
    return {"train_r2": float(np.mean(train)), "test_r2": float(np.mean(test))}


def component_moments(mo: Moments, k: int, scale: bool = False) -> Moments:
    """The moments of the first ``k`` principal components of the columns, from those of the columns.

    Components are those of the plain (unweighted) covariances, or correlations with ``scale``; they are centred, and
    their sign is arbitrary.
    """
    p = len(mo.columns)
    plain = sum(mo.plain.values())
    n, mean = plain[0, 0], plain[0, 1 : p + 1] / plain[0, 0]
    spread = plain[1 : p + 1, 1 : p + 1] / n - np.outer(mean, mean)
    unit = mo.scale[:p]
    if scale:
        unit = np.sqrt((n - 1) / n / np.where(np.diag(spread) > 0, np.diag(spread), 1.0))
    values, vectors = np.linalg.eigh(spread * np.outer(unit, unit))
    turned = vectors[:, np.argsort(values)[::-1][:k]] * unit[:, None]
    t = np.zeros((p + 2, k + 2))
    t[0, 0] = t[-1, -1] = 1.0
    t[1 : p + 1, 1 : k + 1] = turned
    t[0, 1 : k + 1] = -mean @ turned
    names = [f"pca_{i}" for i in range(k)]
    center, size = np.append(np.zeros(k), mo.center[-1]), np.append(np.ones(k), mo.scale[-1])
    return Moments(
        names, mo.folds, {f: t.T @ m @ t for f, m in mo.matrices.items()}, center, size,
        {f: t.T @ m @ t for f, m in mo.plain.items()}, mo.rows, mo.complete,
    )


def component_regression_cv(
    df: DataFrame, columns: Sequence[str], k: int, outcome: str, fold: str, weight: str | None = None, scale: bool = False
) -> dict[str, float]:
    """Mean train and test R2 of the outcome on principal components. The data is read once."""
    mo = cross_products(df, columns, outcome, weight, fold, also_plain=True)
    return r2_by_folds(component_moments(mo, k, scale)) | mo.counts()


def forward_selection(
    df: DataFrame,
    candidates: Mapping[str, Sequence[str]],
    outcome: str,
    weight: str,
    fold: str,
    steps: int = 30,
    descriptions: DataFrame | None = None,
) -> DataFrame:
    """Greedy selection of covariates by mean weighted out-of-sample R2.

    ``candidates`` maps a covariate to its columns. Each step adds the covariate
    with the best score (the first in name order on ties) and stops when no
    covariate improves it. The data is read once, whatever the number of steps,
    candidates and folds. Rows: step, covariate, is_mse, oos_mse, is_r2, oos_r2
    and single_covariate_r2, rounded to 3, the numbers of all and of complete rows, and the description if given.
    """
    columns = list(dict.fromkeys(c for n in sorted(candidates) for c in candidates[n]))
    mo = cross_products(df, columns, outcome, weight, fold)
    out = df.sparkSession.createDataFrame(greedy_selection(mo, candidates, steps), SELECTION_SCHEMA)
    out = out.withColumn("rows", F.lit(mo.rows).cast("long")).withColumn("complete", F.lit(mo.complete).cast("long"))
    return _described(out, descriptions)


def forward_selection_by_group(
    df: DataFrame,
    group: str,
    candidates: Mapping[str, Sequence[str]],
    outcome: str,
    weight: str,
    fold: str,
    steps: int = 10,
    min_rows: int = 100,
    descriptions: DataFrame | None = None,
) -> DataFrame:
    """``forward_selection`` inside every group, from one pass over the data.

    Adds the group, its numbers of all and of complete rows and ``small`` = fewer than ``min_rows``.
    The selection of a group runs in the task that holds its sums; nothing of a
    group comes to the driver, and there may be any number of groups.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    ship_package(df.sparkSession)
    columns = list(dict.fromkeys(c for n in sorted(candidates) for c in candidates[n]))
    sums, center, scale = cross_products_by_group(df, group, columns, outcome, weight, fold)
    kind, side, names = df.schema[group].dataType.simpleString(), len(columns) + 2, SELECTION_SCHEMA.replace(" double", "").replace(" int", "").replace(" string", "").split(", ")
    wanted = {k: list(v) for k, v in candidates.items()}

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        matrices: dict[int, np.ndarray] = {}
        for f, values in zip(rows["fold"], rows["sums"]):
            matrices[int(f)] = matrices.get(int(f), 0.0) + np.asarray(values).reshape(side, side)
        mo = Moments(columns, sorted(matrices), matrices, center, scale)
        found = pd.DataFrame(greedy_selection(mo, wanted, steps), columns=names)
        found.insert(0, group, rows[group].iloc[0])
        return found

    # the tasks' partial sums are added up by the engine, so a group has one row a fold when pandas sees it
    added = sums.groupBy(group, "fold").agg(Summarizer.sum(array_to_vector("sums")).alias("v"))
    added = added.select(group, "fold", vector_to_array("v").alias("sums"))
    out = added.groupBy(group).applyInPandas(select, f"`{group}` {kind}, {SELECTION_SCHEMA}")
    used = F.lit(True)
    for c in [*columns, outcome, weight, fold]:
        used = used & F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double"))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.count_if(used).alias("complete"))
    out = out.join(sizes, group, "left").withColumn("small", F.col("rows") < min_rows)
    return _described(out, descriptions)


SELECTION_SCHEMA = (
    "step int, covariate string, is_mse double, oos_mse double, is_r2 double, oos_r2 double, single_covariate_r2 double"
)


def _described(out: DataFrame, descriptions: DataFrame | None) -> DataFrame:
    if descriptions is None:
        return out
    return out.join(descriptions.select("covariate", "description"), "covariate", "left")


def greedy_selection(mo: Moments, candidates: Mapping[str, Sequence[str]], steps: int) -> list[tuple]:
    """The selection itself, on the matrices: rows as in ``SELECTION_SCHEMA``."""
    names = sorted(candidates)
    whole = mo.total()
    trains = {f: whole - mo.matrices[f] for f in mo.folds}
    var = mo.scale[-1] ** 2

    def evaluate(cols: Sequence[str]) -> np.ndarray:
        idx = mo.index(cols)
        scores = []
        for f in mo.folds:
            coef = solve(trains[f], idx)
            i, o = score(trains[f], idx, coef), score(mo.matrices[f], idx, coef)
            scores.append((i[0] * var, o[0] * var, i[1], o[1]))
        return np.mean(scores, axis=0)

    chosen: list[str] = []
    used: list[str] = []
    table: list[tuple] = []
    while len(chosen) < min(steps, len(names)):
        best = None
        for n in names:
            if n in chosen:
                continue
            s = evaluate([*used, *candidates[n]])
            if best is None or s[3] > best[1][3]:
                best = (n, s)
        if table and not best[1][3] > table[-1][5]:
            break
        chosen.append(best[0])
        used += list(candidates[best[0]])
        idx = mo.index(candidates[best[0]])
        single = score(whole, idx, solve(whole, idx))[1]
        table.append((len(chosen), best[0], *[float(v) for v in best[1]], float(single)))
    return [(r[0], r[1], *[round(v, 3) for v in r[2:]]) for r in table]


# ---------------------------------------------------------------- learners from MLlib


def _features(df: DataFrame, columns: Sequence[str], label: str, weight: str | None, fold: str | None) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    keep = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    used = df.select(
        *keep,
        F.col(label).cast("double").alias("label"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"),
    ).dropna()
    return VectorAssembler(inputCols=[f"x{i}" for i in range(len(columns))], outputCol="features").transform(used)


def _grid_search(data: DataFrame, estimator, grid, folds: int, metric: str = "r2"):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator

    # scores are unweighted
    evaluator = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName=metric)
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, foldCol="fold", parallelism=4
    )
    data = data.persist()
    try:
        return search.fit(data)
    finally:
        data.unpersist()


def _lasso(gram: np.ndarray, xy: np.ndarray, alpha: float, start: np.ndarray, sweeps: int = 1000, tol: float = 1e-9):
    """Minimiser of b'Gb/2 - b'xy + alpha |b|_1 by cyclic coordinate descent."""
    b = start.copy()
    size = np.sqrt(np.maximum(np.diag(gram), 0.0))
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            if size[j] == 0:
                continue
            rest = xy[j] - gram[j] @ b + gram[j, j] * b[j]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / gram[j, j]
            moved = max(moved, abs(new - b[j]) * size[j])
            b[j] = new
        if moved <= tol * max(1.0, float(np.max(np.abs(xy), initial=0.0))):
            break
    return b


def lasso_cv(
    df: DataFrame, columns: Sequence[str], outcome: str, fold: str, alphas: Sequence[float], weight: str | None = None
) -> dict:
    """Lasso with the penalty chosen by cross-validated R2: alpha, score, intercept, coefficients by column.

    The loss is the weighted mean of half the squared error plus alpha times the sum
    of absolute coefficients; the intercept is free and columns are not scaled. The
    scores are unweighted. All penalties and folds are fitted on the cross-products,
    so the data is not read again per penalty or iteration.
    """
    return lasso_of_moments(cross_products(df, columns, outcome, weight, fold, also_plain=True), alphas)


def lasso_of_moments(mo: Moments, alphas: Sequence[float]) -> dict:
    """``lasso_cv`` on all columns of the moments; ``by_fold`` are the (intercept, coefficients) fitted without a fold."""
    idx = mo.index(mo.columns)
    unit, unit_y = mo.scale[:-1], mo.scale[-1]

    def fit(m: np.ndarray, alpha: float, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients on standardised columns (intercept first) and in the units of the data."""
        n = m[0, 0]
        mean = m[0, idx] / n
        gram = m[np.ix_(idx, idx)] / n - np.outer(mean, mean)
        xy = m[idx, -1] / n - mean * (m[0, -1] / n)
        b = _lasso(gram * np.outer(unit, unit), xy * unit * unit_y, alpha, start)
        z = b * unit / unit_y
        return np.concatenate([[m[0, -1] / n - mean @ z], z]), b

    whole = mo.total()
    order = sorted(float(a) for a in alphas)[::-1]  # from strong to weak, each starting at the last solution
    scores = {a: [] for a in order}
    fits: dict[tuple[int, float], tuple[float, list[float]]] = {}

    def in_data(coef: np.ndarray, b: np.ndarray) -> tuple[float, list[float]]:
        return float(mo.center[-1] + coef[0] * unit_y - b @ mo.center[:-1]), [float(v) for v in b]

    for f in mo.folds:
        b = np.zeros(len(idx))
        for a in order:
            coef, b = fit(whole - mo.matrices[f], a, b)
            fits[f, a] = in_data(coef, b)
            scores[a].append(score(mo.plain[f], idx, coef)[1])
    results = {a: float(np.mean(scores[a])) for a in map(float, alphas)}
    best = max(results, key=results.get)
    b = np.zeros(len(idx))
    for a in [x for x in order if x >= best]:
        coef, b = fit(whole, a, b)
    intercept, found = in_data(coef, b)
    return {
        "alpha": best, "r2": results[best], "intercept": intercept, "coefficients": dict(zip(mo.columns, found)),
        "by_fold": {f: fits[f, best] for f in mo.folds}, **mo.counts(),
    }


def out_of_fold(
    df: DataFrame, columns: Sequence[str], outcome: str, fold: str, alphas: Sequence[float] = (0.0,),
    weight: str | None = None, out: str = "predicted",
) -> DataFrame:
    """Add a lasso prediction of every row from the fit that has not seen the row's fold.

    The penalty is chosen by cross-validated R2; 0 is least squares. The fits come from one pass, and the prediction
    is an expression that takes the coefficients of the row's fold. It is NULL if a column or the fold is.
    """
    fits = lasso_of_moments(cross_products(df, columns, outcome, weight, fold, also_plain=True), alphas)["by_fold"]

    def chosen(values: Mapping[int, float]) -> Column:
        pairs = [F.lit(x) for f, v in values.items() for x in (int(f), float(v))]
        return F.try_element_at(F.create_map(*pairs), F.col(fold).cast("int"))

    predicted = chosen({f: fit[0] for f, fit in fits.items()})
    for i, c in enumerate(columns):
        predicted = predicted + F.col(f"`{c}`").cast("double") * chosen({f: fit[1][i] for f, fit in fits.items()})
    return df.withColumn(out, predicted)


def boosted_trees_cv(
    df: DataFrame, columns: Sequence[str], outcome: str, fold: str, folds: int,
    depths: Sequence[int] = (1, 5, 10, 25), leaf_sizes: Sequence[int] = (1, 7, 20),
    weight: str | None = None, trees: int = 100, seed: int = 1234,
) -> dict:
    """Gradient-boosted trees, depth and leaf size chosen by cross-validated R2."""
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml.tuning import ParamGridBuilder

    data = _features(df, columns, outcome, weight, fold)
    gbt = GBTRegressor(weightCol="w", maxIter=trees, stepSize=0.1, seed=seed)
    grid = (
        ParamGridBuilder().addGrid(gbt.maxDepth, list(depths)).addGrid(gbt.minInstancesPerNode, list(leaf_sizes)).build()
    )
    model = _grid_search(data, gbt, grid, folds)
    best = int(np.argmax(model.avgMetrics))
    params = {p.name: v for p, v in grid[best].items()}
    return {
        "max_depth": params["maxDepth"], "min_leaf": params["minInstancesPerNode"], "r2": float(model.avgMetrics[best])
    }


def principal_components(df: DataFrame, columns: Sequence[str], k: int, keep: Sequence[str], scale: bool = False) -> DataFrame:
    """Centred principal components pca_0..pca_{k-1} beside the kept columns of the same row.

    The sign of a component is arbitrary.
    """
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=list(columns), outputCol="__raw").transform(df.dropna(subset=list(columns)))
    centred = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=scale).fit(data).transform(data)
    out = PCA(k=k, inputCol="__x", outputCol="__pc").fit(centred).transform(centred)
    parts = vector_to_array("__pc")
    return out.select(*keep, *[parts[i].alias(f"pca_{i}") for i in range(k)])


def logistic_cv(
    df: DataFrame, columns: Sequence[str], label: str, fold: str, folds: int,
    strengths: Sequence[float] = (1e-2, 1e-1, 1.0, 10.0, 100.0), min_positives: int = 3, iterations: int = 25,
) -> dict | None:
    """Ridge-penalised logistic regression chosen by the mean R2 of the predicted class over the folds.

    ``strengths`` are inverse penalties (C) of the sum of squared coefficients; the intercept is free. None if there
    are too few positives. The columns used are written once, so that what ``df`` joins is not joined (nor broadcast)
    again for every step. Every Newton step reads them once for all folds and penalties: each task adds up the
    reweighted products and slopes of its rows. Returns also the numbers of all and of complete rows.
    """
    ship_package(df.sparkSession)
    p, runs = len(columns), [(f, c) for f in range(folds) for c in strengths]
    names = [f"x{i}" for i in range(p)]
    raw = df.select(
        *[F.col(f"`{c}`").cast("double").alias(n) for n, c in zip(names, columns)], F.col(label).cast("double").alias("y"),
        F.col(fold).cast("int").alias("fold"),
    )
    raw = written_once(raw)
    used = raw.dropna()
    rows, stats = raw.count(), _rough(used, names).first()
    by_fold = {r["fold"]: r for r in used.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()}
    complete, positives = sum(r["n"] for r in by_fold.values()), sum(r["y"] for r in by_fold.values())
    if positives < min_positives:
        return None
    center = np.array([stats[f"m_{n}"] for n in names])
    scale = np.array([stats[f"s_{n}"] or 1.0 for n in names])
    ridge = np.array([[0.0, *(1.0 / (c * scale**2))] for _, c in runs])  # the penalty is on coefficients in data units
    kind = "run int, i int, values array<double>"

    def tasks(beta: np.ndarray, scored: bool):
        def work(batches):
            sums = [np.zeros((p + 1, p + 2)) for _ in runs]
            errors = np.zeros(len(runs))
            for rows in batches:
                x = np.column_stack([np.ones(len(rows)), (rows[names].to_numpy() - center) / scale])
                y, held = rows["y"].to_numpy(), rows["fold"].to_numpy()
                at = 1.0 / (1.0 + np.exp(-np.clip(x @ beta.T, -500, 500)))
                for r, (f, _) in enumerate(runs):
                    if scored:
                        mine = held == f
                        errors[r] += ((y[mine] - (at[mine, r] > 0.5)) ** 2).sum()
                        continue
                    mine = held != f
                    z, q = x[mine], at[mine, r]
                    sums[r][:, :-1] += z.T @ (z * (q * (1 - q))[:, None])
                    sums[r][:, -1] += z.T @ (y[mine] - q)
            if scored:
                yield pd.DataFrame({"run": range(len(runs)), "i": 0, "values": [[float(e)] for e in errors]})
            else:
                for r, m in enumerate(sums):
                    yield pd.DataFrame({"run": r, "i": range(p + 1), "values": [list(v) for v in m]})

        parts = used.mapInPandas(work, kind).select("run", "i", F.posexplode("values").alias("j", "v"))
        return parts.groupBy("run", "i", "j").agg(F.sum("v").alias("v")).collect()

    beta = np.zeros((len(runs), p + 1))
    for _ in range(iterations):
        m = np.zeros((len(runs), p + 1, p + 2))
        for r in tasks(beta, False):
            m[r["run"], r["i"], r["j"]] = r["v"]
        moved = 0.0
        for r in range(len(runs)):
            step = np.linalg.lstsq(m[r, :, :-1] + np.diag(ridge[r]), m[r, :, -1] - ridge[r] * beta[r], rcond=1e-12)[0]
            step *= min(1.0, 10.0 / max(np.abs(step).max(), 1e-300))  # far from the optimum a full step may overshoot
            beta[r] += step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-8:
            break
    errors = {r["run"]: r["v"] for r in tasks(beta, True)}
    scores = {c: [] for c in strengths}
    for r, (f, c) in enumerate(runs):
        if f in by_fold:
            n, ones = by_fold[f]["n"], by_fold[f]["y"]
            spread = ones - ones * ones / n
            scores[c].append(1 - errors[r] / spread if spread > 0 else float("nan"))
    results = {c: float(np.mean(v)) for c, v in scores.items()}
    best = max(strengths, key=lambda c: -math.inf if math.isnan(results[c]) else results[c])
    return {"C": float(best), "r2": results[best], "rows": rows, "complete": complete}


def _rough(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of means and deviations of a few rows."""
    return df.limit(SAMPLE).agg(
        *[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]
    )


def fixed_effects(coefficients: DataFrame, places: DataFrame, prefix: str) -> DataFrame:
    """Coefficients of indicator columns ``<prefix><id>`` beside the location of the id.

    ``coefficients`` has column and coefficient; ``places`` has id and the location.
    """
    ids = coefficients.select(
        F.expr(f"substring(column, {len(prefix) + 1})").alias("id"), "coefficient"
    )
    return ids.join(places.withColumn("id", F.col("id").cast("string")), "id", "left")


# ---------------------------------------------------------------- quantile estimates


def quantile_calibration(
    df: DataFrame, estimates: DataFrame, outcome: str, group: str | None, labels: Sequence[str], closed: bool = False
) -> DataFrame:
    """Share of outcomes below the estimated quantile, per quantile and label.

    ``estimates`` has ``quantile`` and ``estimate``, one row per quantile (and per
    ``group`` if given). Each household is placed once among the sorted estimates of
    its group; the places are counted before the quantiles are spelled out, so the
    households are not multiplied by the number of quantiles.
    """
    groups = [group] if group else []
    lists = estimates.filter(F.col("estimate").isNotNull()).groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct("estimate", "quantile"))).alias("__q")
    )
    here = F.col(outcome)
    joined = join_groups(df, lists, groups)

    def passed(q):
        return q["estimate"] < here if closed else q["estimate"] <= here

    keys = list(dict.fromkeys([*labels, *groups]))
    counts = (
        joined.filter(here.isNotNull())
        .select(*keys, F.size(F.filter("__q", passed)).alias("__place"))
        .groupBy(*keys, "__place")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    each = join_groups(counts, lists, groups).select(*labels, "__place", "__n", F.posexplode("__q").alias("__i", "q"))
    return each.groupBy(*labels, F.col("q.quantile").alias("quantile")).agg(
        (F.sum(F.when(F.col("__i") >= F.col("__place"), F.col("__n")).otherwise(0)) / F.sum("__n")).alias(
            "actual_below_estimated"
        )
    )


def mean_pinball_loss(
    df: DataFrame, outcome: str, estimate: str, tau, weight: str, by: Sequence[str] = ()
) -> DataFrame:
    """Weighted mean pinball loss of given estimates."""
    from welfarelens.functions.learning import pinball_loss

    loss = pinball_loss(outcome, estimate, tau)
    ok = loss.isNotNull()
    return df.groupBy(*by).agg(
        F.try_divide(F.sum(F.when(ok, F.col(weight) * loss)), F.sum(F.when(ok, F.col(weight)))).alias("pinball_loss")
    )
