"""Grids of models over column sets, outcomes and groupings, and area effects."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from welfarelens.operators import dedup as U, quality as Q, regress as R, split as S
from welfarelens.session import written_once


@dataclass
class ModelSpec:
    """One cell of the grid. ``group`` keeps its areas together in cross-validation."""

    name: str
    columns: Sequence[str]
    outcome: str
    group: str | None = None
    components: int | None = None
    alphas: Sequence[float] = ()
    trees: bool = False


GRID_SCHEMA = (
    "columns string, outcome string, grouped_by string, n_pca int, lr_oos double, lr_is double, "
    "lasso_oos double, lasso_best_alpha double, gb_oos double, rows long, complete long, run int"
)
#: Folds of different schemes are told apart by this step between their numbers.
SCHEME = 1000


def model_grid(
    df: DataFrame, specs: Sequence[ModelSpec], id_column: str, weight: str, folds: int = 5, seed: int = 0
) -> DataFrame:
    """Cross-validated scores of every spec; of specs with the same labels the last one stays.

    One pass collects the products of all columns and outcomes for all ways of cutting folds; every linear model, lasso
    and principal component regression is then matrix algebra, so the number of jobs does not grow with the specs (only
    boosted trees read the data again). All scores refer to the rows that are complete in all columns of the grid;
    ``rows`` and ``complete`` say how many there are in all and how many of these.
    """
    specs = list(specs)
    schemes = list(dict.fromkeys(s.group for s in specs))
    marked = df
    for i, group in enumerate(schemes):
        marked = S.group_folds(marked, group, folds) if group else S.even_folds(marked, id_column, folds, seed)
        marked = marked.withColumnRenamed("fold", f"__fold_{i}")
    outcomes = list(dict.fromkeys(s.outcome for s in specs))
    columns = list(dict.fromkeys(c for s in specs for c in s.columns if c not in outcomes)) + outcomes[:-1]
    numbers = [F.col(f"__fold_{i}") + F.lit(i * SCHEME) for i in range(len(schemes))]
    mo = R.fold_moments(marked, columns, outcomes[-1], weight, numbers)
    rows = []
    for run, s in enumerate(specs):
        scheme = schemes.index(s.group)
        here = mo.pick(s.columns, s.outcome, [f for f in mo.folds if f // SCHEME == scheme])
        used = R.component_moments(here, s.components) if s.components else here
        linear = R.r2_by_folds(used)
        lasso = R.lasso_of_moments(used, s.alphas) if s.alphas else {}
        trees = {}
        if s.trees:
            data = marked.withColumnRenamed(f"__fold_{scheme}", "fold")
            names = list(s.columns)
            if s.components:
                data = R.principal_components(data, names, s.components, [id_column, s.outcome, weight, "fold"])
                names = [f"pca_{i}" for i in range(s.components)]
            trees = R.boosted_trees_cv(data, names, s.outcome, "fold", folds, weight=weight)
        rows.append(
            (s.name, s.outcome, s.group, s.components, linear["test_r2"], linear["train_r2"], lasso.get("r2"),
             lasso.get("alpha"), trees.get("r2"), mo.rows, mo.complete, run)
        )
    table = df.sparkSession.createDataFrame(rows, GRID_SCHEMA)
    return U.keep_last(table, ["columns", "outcome", "grouped_by", "n_pca"], ["run"]).drop("run")


# ---------------------------------------------------------------- area effects

#: Intervals into which the range that holds an intercept is cut in one pass, and breakpoints solved on the driver.
STEPS, FEW_BREAKS = 1024, 1000


def _events(areas: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """Where the slope of the intercept's equation changes: an area leaves one bound of the penalty and meets the other.

    An area of mean ``m`` and weight ``w`` adds ``w (m - c)``, but no more than the penalty ``alpha W`` either way, so
    it is linear in ``c`` between ``m - alpha W / w`` and ``m + alpha W / w``.
    """
    each = areas.select("set", "w", "m", "all_w", F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))
    reach = F.col("alpha") * F.col("all_w") / F.col("w")
    return each.select(
        "set", "alpha",
        F.explode(
            F.array(
                F.struct((F.col("m") - reach).alias("at"), F.lit(-1).alias("above"), F.lit(0).alias("below"), F.col("w").alias("w"), (F.col("w") * F.col("m")).alias("wm")),
                F.struct((F.col("m") + reach).alias("at"), F.lit(0).alias("above"), F.lit(1).alias("below"), (-F.col("w")).alias("w"), (-F.col("w") * F.col("m")).alias("wm")),
            )
        ).alias("e"),
    ).select("set", "alpha", "e.*").groupBy("set", "alpha", "at").agg(
        F.sum("above").alias("above"), F.sum("below").alias("below"), F.sum("w").alias("w"), F.sum("wm").alias("wm")
    )


def _root(start: dict, events: list, bound: float) -> float:
    """The intercept at which the areas' parts cancel; the middle of the interval if there is one.

    ``start`` are the sums left of all ``events``, which are ascending (at, above, below, w, wm), and where the events
    before and after them are.
    """
    sums = [start[k] for k in ("above", "below", "w", "wm")]
    ends = [start["from"], *(e[0] for e in events), start["to"]]
    first = last = None
    for n in range(len(ends) - 1):
        lo, hi = ends[n], ends[n + 1]
        if n:
            sums = [x + d for x, d in zip(sums, events[n - 1][1:])]
        above, below, w, wm = sums
        level = abs(w) <= 1e-12 * start["total"]
        if level and above == below:  # zero all along
            first, last = lo if first is None else first, hi
            continue
        if first is not None:
            break
        if hi is None or bound * (above - below) + wm - w * hi <= 0:
            root = lo if level else max(lo, (wm + bound * (above - below)) / w)
            return root if hi is None else min(hi, root)
    if first is None:
        return events[-1][0]
    return first if last is None else (first + last) / 2


def intercepts(areas: DataFrame, alphas: Sequence[float]) -> dict[tuple[int, float], float]:
    """The free intercept of the lasso on the indicators of all areas, by set of rows and penalty.

    ``areas`` has ``set``, an area's weight ``w`` and weighted mean ``m``, and the set's weight ``all_w``. The sums that
    decide are monotone in the intercept, so each pass cuts the range that holds it into intervals and goes on with
    one of them; a bounded number of sums and in the end of breakpoints reaches the driver.
    """
    events = written_once(_events(areas, alphas))
    weights = {r["set"]: r["all_w"] for r in areas.groupBy("set").agg(F.max("all_w").alias("all_w")).collect()}
    spans = events.groupBy("set", "alpha").agg(
        F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("below").alias("areas")
    ).collect()
    # nothing is left of the first breakpoint: all areas are above
    open_ = {(r["set"], r["alpha"]): {"lo": r["lo"], "hi": r["hi"], "n": r["n"], "above": r["areas"], "below": 0, "w": 0.0, "wm": 0.0, "from": r["lo"], "to": None, "total": weights[r["set"]]} for r in spans}
    found: dict[tuple[int, float], float] = {}
    schema = "set int, alpha double, lo double, hi double"
    while open_:
        few = {k: v for k, v in open_.items() if v["n"] <= FEW_BREAKS or v["lo"] == v["hi"]}
        if few:
            held = F.broadcast(events.sparkSession.createDataFrame([(*k, v["lo"], v["hi"]) for k, v in few.items()], schema))
            rows: dict = {}
            for r in events.join(held, ["set", "alpha"]).filter("at >= lo and at <= hi").collect():
                rows.setdefault((r["set"], r["alpha"]), []).append((r["at"], r["above"], r["below"], r["w"], r["wm"]))
            for k, v in few.items():
                found[k] = _root(v, sorted(rows[k]), k[1] * v["total"])
                del open_[k]
            continue
        held = F.broadcast(events.sparkSession.createDataFrame([(*k, v["lo"], v["hi"]) for k, v in open_.items()], schema))
        step = F.least(F.floor((F.col("at") - F.col("lo")) / (F.col("hi") - F.col("lo")) * STEPS), F.lit(STEPS - 1)).cast("int")
        cells: dict = {}
        counted = events.join(held, ["set", "alpha"]).filter("at >= lo and at <= hi").withColumn("step", step)
        for r in counted.groupBy("set", "alpha", "step").agg(
            F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n"),
            *[F.sum(c).alias(c) for c in ("above", "below", "w", "wm")],
        ).collect():
            cells.setdefault((r["set"], r["alpha"]), []).append(r)
        for k, rows in cells.items():
            state, bound = dict(open_[k]), k[1] * open_[k]["total"]
            rows.sort(key=lambda r: r["step"])
            for n, r in enumerate(rows):
                after = {c: state[c] + r[c] for c in ("above", "below", "w", "wm")}
                to = rows[n + 1]["lo"] if n + 1 < len(rows) else open_[k]["to"]
                if to is None or bound * (after["above"] - after["below"]) + after["wm"] - after["w"] * to <= 0:
                    open_[k] = {**state, "lo": r["lo"], "hi": r["hi"], "n": r["n"], "to": to}
                    break
                state |= {**after, "from": r["hi"]}
    return found


def area_effects(
    df: DataFrame, area: str, location: Sequence[str], outcome: str, id_column: str, weight: str,
    alphas: Sequence[float] = (1e-4,), folds: int = 5, seed: int = 0,
) -> DataFrame:
    """Lasso coefficient of every area's indicator beside the area's location (its first record).

    The indicators' products are diagonal, so they are never spelled out: one pass sums weights and outcomes by area
    and fold, the intercept solves an equation in one unknown, and an area's coefficient is the distance of its mean
    from the intercept, shortened by its share of the penalty. The penalty is chosen by the unweighted R2 over the
    folds. There may be millions of areas. Rows without an area, outcome or weight are left out.
    """
    folded = S.even_folds(df.select(id_column, area, outcome, weight), id_column, folds, seed)
    y, w = F.col(outcome).cast("double"), F.col(weight).cast("double")
    known = folded.filter(F.col(area).isNotNull() & y.isNotNull() & ~F.isnan(y) & w.isNotNull())
    sums = written_once(
        known.groupBy(F.col(area).alias("area"), "fold").agg(
            F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy")
        )
    )
    sets = F.array(*[F.lit(f) for f in range(-1, folds if len(alphas) > 1 else 0)])  # -1: all rows, else all but a fold
    each = sums.withColumn("set", F.explode(sets)).filter("set <> fold").groupBy("set", "area").agg(
        F.sum("w").alias("w"), F.sum("wy").alias("wy")
    ).filter("w > 0").withColumn("m", F.col("wy") / F.col("w"))
    totals = each.groupBy("set").agg(F.sum("w").alias("all_w"))
    areas = written_once(each.join(F.broadcast(totals), "set"))  # a row per set
    roots = intercepts(areas, alphas)
    solved = F.broadcast(
        df.sparkSession.createDataFrame([(*k, c) for k, c in roots.items()], "set int, alpha double, intercept double")
    )
    gap = F.col("m") - F.col("intercept")
    rest = F.greatest(F.abs(gap) - F.col("alpha") * F.col("all_w") / F.col("w"), F.lit(0.0))
    fitted = areas.join(solved, "set").withColumn("coefficient", F.signum(gap) * rest)
    best = float(alphas[0])
    if len(alphas) > 1:
        test = sums.join(solved.filter("set >= 0"), F.col("fold") == F.col("set")).drop("set")
        held = fitted.filter("set >= 0").select("area", F.col("set").alias("fold"), "alpha", "coefficient")
        test = test.join(held, ["area", "fold", "alpha"], "left")
        p = F.col("intercept") + F.coalesce("coefficient", F.lit(0.0))
        scores = test.groupBy("alpha", "fold").agg(
            F.sum(F.col("yy") - 2 * p * F.col("y") + F.col("n") * p * p).alias("sse"),
            (F.sum("yy") - F.sum("y") * F.sum("y") / F.sum("n")).alias("sst"),
        ).groupBy("alpha").agg(F.avg(1 - F.try_divide("sse", "sst")).alias("r2"))
        best = max(((r["r2"], -r["alpha"]) for r in scores.collect() if r["r2"] is not None), default=(0, -best))[1] * -1
    chosen = fitted.filter((F.col("set") == -1) & (F.col("alpha") == F.lit(best)))
    places = Q.group_first(df, area, list(location), id_column).withColumnRenamed(area, "area")
    out = chosen.select("area", "coefficient").join(places, "area", "left")
    return out.select(F.col("area").cast("string").alias("id"), "coefficient", *location)
