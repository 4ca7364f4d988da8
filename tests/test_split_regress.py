import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from welfarelens.operators import regress as R, split as S
from welfarelens.plans import predictors as M


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice(["x", "y", None])) for i in range(997)]
    return spark.createDataFrame(rows, "id long, s string").repartition(5)


def test_stratified_split_quotas_and_determinism(people):
    out = S.stratified_split(people, "id", 0.6, 1, ["s"])
    sizes = {r["s"]: r["n"] for r in people.groupBy("s").agg(F.count("*").alias("n")).collect()}
    train = {r["s"]: r["n"] for r in out.filter("split = 'train'").groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert out.count() == 997 and sum(train.values()) == math.floor(0.6 * 997 + 0.5)
    assert all(abs(train[s] - 0.6 * n) < 1 for s, n in sizes.items())
    again = S.stratified_split(people.repartition(2), "id", 0.6, 1, ["s"])
    key = lambda d: sorted((r["id"], r["split"]) for r in d.collect())
    assert key(out) == key(again)
    assert key(out) != key(S.stratified_split(people, "id", 0.6, 2, ["s"]))


def test_unstratified_split_and_tiny_strata(spark, people):
    assert S.stratified_split(people, "id", 0.25, 3).filter("split = 'train'").count() == math.floor(0.25 * 997 + 0.5)
    tiny = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, s string")
    got = S.stratified_split(tiny, "id", 0.6, 3, ["s"]).filter("split = 'train'").count()
    assert got == 2  # no stratum reaches a whole row, the remainders decide


def test_even_folds(people):
    for by in ((), ("s",)):
        out = S.even_folds(people, "id", 10, 7, by)
        counts = out.groupBy(*by, "fold").agg(F.count("*").alias("n")).collect()
        assert sum(r["n"] for r in counts) == 997
        for s in {r["s"] for r in counts} if by else {None}:
            ns = [r["n"] for r in counts if not by or r["s"] == s]
            assert max(ns) - min(ns) <= 1 and len(ns) == 10


def test_shuffled_places(spark, people, monkeypatch):
    monkeypatch.setattr(S, "SHUFFLED_TOGETHER", 20)
    out = S.shuffled(people, "id", 3).collect()
    assert sorted(r["place"] for r in out) == list(range(1, 998))
    order = sorted((r["id"] for r in out), key=lambda i: (hashlib.md5(f"3:{i}".encode()).hexdigest()[:15], str(i)))
    assert [r["id"] for r in sorted(out, key=lambda r: r["place"])] == order
    assert S.shuffled(people.limit(0), "id").count() == 0


def test_many_strata_are_ranked_in_ranges(spark):
    strata = spark.range(60_000).select("id", F.col("id").alias("s"), (F.col("id") % 7 + 1).alias("rows"))
    quotas = S.stratum_quotas(strata.select("s", "rows"), 0.6, ["s"])
    assert quotas.agg(F.sum("quota")).first()[0] == math.floor(0.6 * strata.agg(F.sum("rows")).first()[0] + 0.5)
    assert "SinglePartition" not in quotas._jdf.queryExecution().toString()
    rest = lambda n: round(n * 0.6 - math.floor(n * 0.6 + 1e-9), 9)
    raised = {r["s"]: r["quota"] > math.floor(r["rows"] * 0.6 + 1e-9) for r in quotas.collect()}
    ranked = sorted(range(60_000), key=lambda s: (-rest(s % 7 + 1), s))
    extra = sum(raised.values())
    assert all(raised[s] for s in ranked[:extra])


def test_more_folds_than_rows(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    got = sorted(r["fold"] for r in S.even_folds(df, "id", 5).collect())
    n = [round(i * 2 / 5) for i in range(6)]
    assert got == [f for f in range(5) for _ in range(n[f + 1] - n[f])]


def test_random_split_weights(people):
    out = S.random_split(people, "id", 0.6)
    rows = {r["split"]: (r["n"], r["w"]) for r in out.groupBy("split").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert rows["train"][0] == math.floor(0.6 * 997) and rows["test"][0] == 997 - rows["train"][0]
    assert rows["train"][1] == pytest.approx(1.0) and rows["test"][1] == pytest.approx(1.0)


@pytest.mark.parametrize("share", [0.001, 0.5])
def test_group_folds(spark, share):
    rng = random.Random(8)
    rows = [(i, "big" if rng.random() < 0.3 else None if i % 50 == 0 else f"g{rng.randint(0, 120)}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string")
    out = S.group_folds(df, "g", 4, share)
    assert out.count() == 2000
    assert out.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()
    sizes = sorted(r["n"] for r in out.groupBy("fold").agg(F.count("*").alias("n")).collect())
    assert len(sizes) == 4 and sizes[-1] <= 640 and sizes[0] > 350


# ---------------------------------------------------------------- regression


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=(n, 4)) * [1, 100, 0.01, 1] + [0, 1000, 5, 0]
    cat = rng.integers(0, 3, n)
    hot = np.eye(3)[cat]
    y = 2 + 3 * x[:, 0] + 0.02 * x[:, 1] + hot @ [0, 1, 2] + rng.normal(size=n)
    w = rng.integers(1, 5, n) / 2
    fold = np.arange(n) % 5
    return x, hot, y, w, fold


@pytest.fixture(scope="module")
def frame(spark, data):
    x, hot, y, w, fold = data
    rows = [tuple(map(float, [*x[i], *hot[i], y[i], w[i]])) + (int(fold[i]),) for i in range(len(y))]
    rows.append((None, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0))  # incomplete rows are left out
    cols = "a double, b double, c double, d double, h0 double, h1 double, h2 double, y double, w double, fold int"
    return spark.createDataFrame(rows, cols)


def lstsq(x, y, w):
    a = np.column_stack([np.ones(len(x)), x]) * np.sqrt(w)[:, None]
    return np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0]


def r2(y, p, w):
    m = np.average(y, weights=w)
    return 1 - (w * (y - p) ** 2).sum() / (w * (y - m) ** 2).sum()


def test_weighted_least_squares(data, frame):
    x, hot, y, w, _ = data
    fit = R.weighted_least_squares(frame, ["a", "b", "c"], "y", "w")
    beta = lstsq(x[:, :3], y, w)
    assert [fit.intercept, *fit.coefficients] == pytest.approx(list(beta), rel=1e-6)
    p = np.column_stack([np.ones(len(y)), x[:, :3]]) @ beta
    assert fit.r2 == pytest.approx(r2(y, p, w)) and fit.mse == pytest.approx(np.average((y - p) ** 2, weights=w))
    got = frame.dropna().select(F.sum(fit.predict())).first()[0]
    assert got == pytest.approx(p.sum(), rel=1e-6)


def test_singular_design_and_leakage(data, frame):
    x, hot, y, w, _ = data
    # one-hot with intercept: singular
    fit = R.weighted_least_squares(frame.dropna(), ["h0", "h1", "h2"], "y", "w")
    p = np.column_stack([np.ones(len(y)), hot]) @ lstsq(hot, y, w)
    assert fit.r2 == pytest.approx(r2(y, p, w))
    with pytest.raises(ValueError):
        R.check_leakage(frame.withColumn("leak", F.col("y") * 2), ["leak"], "y", "w")


def test_wide_and_narrow_sums_agree(frame):
    cols = ["a", "b", "c", "d", "h0"]
    narrow = R.cross_products(frame, cols, "y", "w", "fold", also_plain=True)
    old, R.NARROW = R.NARROW, 2
    try:
        wide = R.cross_products(frame, cols, "y", "w", "fold", also_plain=True)
    finally:
        R.NARROW = old
    for f in narrow.folds:
        assert np.allclose(narrow.matrices[f], wide.matrices[f])
        assert np.allclose(narrow.plain[f], wide.plain[f])


def test_cross_validation_scores_without_weights(data, frame):
    x, hot, y, w, fold = data
    got = R.cross_validated_r2(frame, ["a", "b"], "y", "fold", "w")
    test = []
    for f in range(5):
        tr = fold != f
        beta = lstsq(x[tr, :2], y[tr], w[tr])
        p = np.column_stack([np.ones((~tr).sum()), x[~tr, :2]]) @ beta
        test.append(r2(y[~tr], p, np.ones((~tr).sum())))
    assert got["test_r2"] == pytest.approx(np.mean(test))


def brute_forward(x, y, w, fold, candidates):
    """Refit for every step, candidate and fold, as one would without the matrices."""
    chosen, used, last, out = [], [], None, []
    while len(chosen) < len(candidates):
        best = None
        for n in sorted(candidates):
            if n in chosen:
                continue
            cols = used + candidates[n]
            s = []
            for f in range(5):
                tr = fold != f
                beta = lstsq(x[tr][:, cols], y[tr], w[tr])
                p = np.column_stack([np.ones(len(y)), x[:, cols]]) @ beta
                s.append((r2(y[tr], p[tr], w[tr]), r2(y[~tr], p[~tr], w[~tr])))
            s = np.mean(s, axis=0)
            if best is None or s[1] > best[1][1]:
                best = (n, s)
        if last is not None and not best[1][1] > last:
            break
        chosen.append(best[0])
        used += candidates[best[0]]
        last = best[1][1]
        out.append((best[0], round(best[1][0], 3), round(best[1][1], 3)))
    return out


def test_forward_selection(spark, data, frame):
    x, hot, y, w, fold = data
    names = ["a", "b", "c", "d", "h0", "h1", "h2"]
    candidates = {"a": ["a"], "b": ["b"], "c": ["c"], "d": ["d"], "hot": ["h0", "h1", "h2"]}
    text = spark.createDataFrame([("a", "first")], "covariate string, description string")
    got = R.forward_selection(frame, candidates, "y", "w", "fold", descriptions=text).orderBy("step").collect()
    want = brute_forward(
        np.column_stack([x, hot]), y, w, fold, {k: [names.index(c) for c in v] for k, v in candidates.items()}
    )
    assert [(r["covariate"], r["is_r2"], r["oos_r2"]) for r in got] == want
    assert got[0]["covariate"] == "a" and got[0]["description"] == "first"


def test_forward_selection_by_group(frame):
    candidates = {"a": ["a"], "b": ["b"]}
    df = frame.withColumn("g", F.when(F.col("h0") == 1, "p").when(F.col("h1") == 1, "q"))
    got = R.forward_selection_by_group(df, "g", candidates, "y", "w", "fold", steps=1, min_rows=1000)
    rows = {r["g"]: r for r in got.collect()}
    assert set(rows) == {"p", "q"} and all(r["small"] for r in rows.values())
    alone = R.forward_selection(df.filter("g = 'p'"), candidates, "y", "w", "fold", steps=1).first()
    assert rows["p"]["covariate"] == alone["covariate"] and rows["p"]["oos_r2"] == alone["oos_r2"]


def test_univariate_r2_of_constant_is_zero(frame, data):
    x, _, y, w, _ = data
    got = dict(map(tuple, R.univariate_r2(frame.dropna().withColumn("k", F.lit(3.0)), ["a", "b", "k"], "y", "w").collect()))
    p = np.column_stack([np.ones(len(y)), x[:, :1]]) @ lstsq(x[:, :1], y, w)
    assert got["a"] == pytest.approx(r2(y, p, w)) and got["k"] == 0.0


def test_lasso_meets_optimality_conditions(frame, data):
    x, hot, y, w, _ = data
    alpha = 0.05
    fit = R.lasso_cv(frame, ["a", "b", "c", "d"], "y", "fold", [alpha], "w")
    b = np.array(list(fit["coefficients"].values()))
    resid = y - fit["intercept"] - x @ b
    wn = w / w.sum()
    assert (wn * resid).sum() == pytest.approx(0, abs=1e-6)
    slope = (x - wn @ x).T @ (wn * resid)
    for j in range(4):
        if b[j] != 0:
            assert slope[j] == pytest.approx(alpha * np.sign(b[j]), abs=1e-5)
        else:
            assert abs(slope[j]) <= alpha + 1e-5


def test_lasso_picks_best_penalty(frame):
    fit = R.lasso_cv(frame, ["a", "b"], "y", "fold", [1e-4, 50.0], "w")
    assert fit["alpha"] == 1e-4 and fit["r2"] > 0.5


def test_learners(frame):
    data = frame.dropna()
    trees = R.boosted_trees_cv(data, ["a", "b"], "y", "fold", 5, depths=(2,), leaf_sizes=(1,), weight="w", trees=3)
    assert trees["max_depth"] == 2 and trees["r2"] > 0
    parts = R.principal_components(data, ["a", "b", "c"], 2, ["y"], scale=True)
    assert parts.columns == ["y", "pca_0", "pca_1"]
    assert abs(parts.agg(F.avg("pca_0")).first()[0]) < 1e-9
    flag = data.withColumn("z", (F.col("y") > 22).cast("double"))
    assert R.logistic_cv(flag, ["a", "b"], "z", "fold", 5, strengths=(1.0,))["C"] == 1.0
    assert R.logistic_cv(flag.withColumn("z", F.lit(0.0)), ["a"], "z", "fold", 5) is None


def test_calibration(spark):
    df = spark.createDataFrame([("a", 1.0, "t"), ("a", 2.0, "t"), ("b", 3.0, "t"), ("b", None, "t")], "g string, y double, set string")
    est = spark.createDataFrame([("a", 0.1, 1.5), ("b", 0.1, 3.0), ("a", 0.9, 9.0), ("b", 0.9, 9.0)], "g string, quantile double, estimate double")
    got = {r["quantile"]: r["actual_below_estimated"] for r in R.quantile_calibration(df, est, "y", "g", ["set"]).collect()}
    assert got == {0.1: pytest.approx(1 / 3), 0.9: 1.0}
    closed = {r["quantile"]: r["actual_below_estimated"] for r in R.quantile_calibration(df, est, "y", "g", ["set"], closed=True).collect()}
    assert closed[0.1] == pytest.approx(2 / 3)


def test_forward_selection_in_very_many_groups(spark):
    rows = spark.range(36_000).select(
        (F.col("id") % 6000).alias("g"), F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("a"),
        F.lit(1.0).alias("w"), (F.floor(F.col("id") / 6000) % 2).cast("int").alias("fold"),
    ).withColumn("y", F.col("a") * 2 + F.col("g") % 7)
    got = R.forward_selection_by_group(rows, "g", {"a": ["a"]}, "y", "w", "fold", steps=1)
    assert got.select("g").distinct().count() == 6000


# ---------------------------------------------------------------- shared moments, area effects


def test_rows_lost_to_missing_values_are_counted(frame):
    both = {"rows": 401, "complete": 400}
    assert both.items() <= R.cross_validated_r2(frame, ["a", "b"], "y", "fold", "w").items()
    assert both.items() <= R.lasso_cv(frame, ["a", "b"], "y", "fold", [0.1], "w").items()
    fit = R.weighted_least_squares(frame, ["a"], "y", "w")
    assert (fit.rows, fit.complete) == (401, 400)
    nan = frame.withColumn("b", F.when(F.col("fold") == 2, F.lit(float("nan"))).otherwise(F.col("b")))
    assert R.weighted_least_squares(nan, ["b"], "y", "w").complete == 321
    picked = R.forward_selection(frame, {"a": ["a"]}, "y", "w", "fold").first()
    assert (picked["rows"], picked["complete"]) == (401, 400)
    grouped = R.forward_selection_by_group(frame.withColumn("g", F.lit("x")), "g", {"a": ["a"]}, "y", "w", "fold", steps=1).first()
    assert (grouped["rows"], grouped["complete"]) == (401, 400)


def test_untypical_first_rows_do_not_spoil_the_sums(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full(2000, 1e9) + rng.normal(size=2000) * 1e-3, rng.normal(size=3000)])
    y = 3 * np.where(np.arange(5000) < 2000, 0, x) + rng.normal(size=5000)
    df = spark.createDataFrame(list(zip(map(float, x[2000:]), map(float, y[2000:]))), "x double, y double")
    first = spark.createDataFrame([(1e9, 1.0)] * 2500, "x double, y double").limit(0)
    fit = R.weighted_least_squares(first.unionByName(df), ["x"], "y")
    assert fit.coefficients[0] == pytest.approx(np.polyfit(x[2000:], y[2000:], 1)[0], rel=1e-9)
    shifted = spark.range(4000, numPartitions=4).select(
        (F.when(F.col("id") < 3000, F.lit(5.0)).otherwise(1e7) + F.col("id") % 7).alias("x")
    ).withColumn("y", F.col("x") * 2 + 1)
    fit = R.weighted_least_squares(shifted, ["x"], "y")
    assert fit.coefficients[0] == pytest.approx(2, rel=1e-9) and fit.r2 == pytest.approx(1)


def test_components_from_the_moments(frame):
    data = frame.dropna()
    for scale in (False, True):
        got = R.component_regression_cv(frame, ["a", "b", "c"], 2, "y", "fold", "w", scale)
        parts = R.principal_components(data, ["a", "b", "c"], 2, ["y", "fold", "w"], scale)
        want = R.cross_validated_r2(parts, ["pca_0", "pca_1"], "y", "fold", "w")
        assert got["test_r2"] == pytest.approx(want["test_r2"], rel=1e-6)
        assert got["train_r2"] == pytest.approx(want["train_r2"], rel=1e-6)


def test_out_of_fold_predictions(data, frame):
    x, hot, y, w, fold = data
    rows = R.out_of_fold(frame, ["a", "b"], "y", "fold", weight="w").collect()
    assert sum(r["predicted"] is None for r in rows) == 1
    got = {(r["a"], r["b"]): r["predicted"] for r in rows if r["predicted"] is not None}
    for f in range(5):
        tr = fold != f
        beta = lstsq(x[tr, :2], y[tr], w[tr])
        for a, b in x[~tr, :2]:
            assert got[float(a), float(b)] == pytest.approx(beta[0] + beta[1] * a + beta[2] * b, rel=1e-5)


def ridge_logit(x, z, c):
    """Plain damped Newton steps on half the sum of squared coefficients over C plus the log loss."""
    a = np.column_stack([np.ones(len(x)), x])
    d = np.diag([0.0, *[1 / c] * x.shape[1]])
    b = np.zeros(a.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -500, 500)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + d, a.T @ (z - p) - d @ b)
        b = b + step * min(1.0, 1.0 / np.abs(a @ step).max() * 5)
    return b


def test_logistic_regression_meets_optimality_conditions(data, frame):
    x, hot, y, w, fold = data
    flag = frame.withColumn("z", (F.col("y") > 22).cast("double"))
    z = (y > 22).astype(float)
    for c in (0.05, 10.0):
        got = R.logistic_cv(flag, ["a", "b"], "z", "fold", 5, strengths=(c,))
        scores = []
        for f in range(5):
            tr = fold != f
            b = ridge_logit(x[tr, :2], z[tr], c)
            hit = (np.column_stack([np.ones((~tr).sum()), x[~tr, :2]]) @ b > 0).astype(float)
            scores.append(r2(z[~tr], hit, np.ones((~tr).sum())))
        assert got["r2"] == pytest.approx(np.mean(scores)) and got["complete"] == 400 and got["rows"] == 401


def test_model_grid_from_one_pass(spark, frame):
    df = frame.withColumn("id", F.monotonically_increasing_id()).withColumn("g", F.when(F.col("h0") == 1, "p").otherwise(F.concat(F.lit("q"), F.col("id") % 9)))
    df = spark.createDataFrame(df.drop("fold").collect(), df.drop("fold").schema)
    specs = [
        M.ModelSpec("ab", ["a", "b"], "y"), M.ModelSpec("abc", ["a", "b", "c"], "y", group="g", alphas=[0.01, 1.0]),
        M.ModelSpec("abc", ["a", "b", "c"], "y", components=2), M.ModelSpec("ab", ["a", "b"], "d"), M.ModelSpec("ab", ["a"], "y"),
    ]
    got = {(r["columns"], r["outcome"], r["grouped_by"], r["n_pca"]): r for r in M.model_grid(df, specs, "id", "w").collect()}
    assert len(got) == 4 and all((r["rows"], r["complete"]) == (401, 400) for r in got.values())
    full = df.dropna(subset=["a"])
    even, grouped = S.even_folds(df, "id", 5, 0).dropna(), S.group_folds(df, "g", 5).dropna()
    assert full.count() == 400
    assert got["ab", "y", None, None]["lr_oos"] == pytest.approx(R.cross_validated_r2(even, ["a"], "y", "fold", "w")["test_r2"])
    assert got["ab", "d", None, None]["lr_is"] == pytest.approx(R.cross_validated_r2(even, ["a", "b"], "d", "fold", "w")["train_r2"])
    lasso = R.lasso_cv(grouped, ["a", "b", "c"], "y", "fold", [0.01, 1.0], "w")
    assert got["abc", "y", "g", None]["lasso_oos"] == pytest.approx(lasso["r2"]) and got["abc", "y", "g", None]["lasso_best_alpha"] == lasso["alpha"]


def area_rows(seed, areas):
    rng = random.Random(seed)
    return [(i, f"a{rng.randrange(areas)}", rng.choice([1.0, 2.0, 2.5, rng.gauss(3, 2)]), float(rng.randint(1, 4)), rng.random()) for i in range(6 * areas)]


@pytest.mark.parametrize("steps,few", [(1024, 1000), (4, 3)])
def test_area_effects_meet_optimality_conditions(spark, monkeypatch, steps, few):
    monkeypatch.setattr(M, "STEPS", steps)
    monkeypatch.setattr(M, "FEW_BREAKS", few)
    rows = area_rows(1, 60)
    df = spark.createDataFrame([*rows, (-1, None, 5.0, 1.0, 0.0), (-2, "a1", None, 1.0, 0.0)], "id long, area string, y double, w double, x double")
    total = sum(r[3] for r in rows)
    sums = {}
    for _, a, y, w, _ in rows:
        s = sums.setdefault(a, [0.0, 0.0])
        s[0] += w
        s[1] += w * y
    for alpha in (1e-9, 1e-4, 3e-3, 0.02, 5.0):
        got = {r["id"]: r["coefficient"] for r in M.area_effects(df, "area", ["x"], "y", "id", "w", [alpha]).collect()}
        assert set(got) == set(sums)
        shifts = [sums[a][1] / sums[a][0] - b - alpha * total / sums[a][0] * np.sign(b) for a, b in got.items() if b]
        c = np.median(shifts) if shifts else sum(s[1] for s in sums.values()) / total
        assert np.allclose(shifts, c, atol=1e-9)
        left = {a: (sums[a][1] / sums[a][0] - c - b) * sums[a][0] / total for a, b in got.items()}
        assert sum(left.values()) == pytest.approx(0, abs=1e-9)
        assert all(abs(v) <= alpha + 1e-9 for v in left.values())
    means = sorted(s[1] / s[0] for s in sums.values())
    tiny = {r["id"]: r["coefficient"] for r in M.area_effects(df, "area", ["x"], "y", "id", "w", [1e-12]).collect()}
    middle = (means[29] + means[30]) / 2 if len(means) == 60 else np.median(means)
    assert all(b == pytest.approx(sums[a][1] / sums[a][0] - middle, abs=1e-6) for a, b in tiny.items())


def test_area_effects_choose_the_penalty_and_first_places(spark):
    rows = area_rows(2, 25)
    df = spark.createDataFrame(rows, "id long, area string, y double, w double, x double")
    got = M.area_effects(df, "area", ["x"], "y", "id", "w", [1e-4, 1e-2, 100.0]).collect()
    scores = {}
    hot = S.even_folds(df, "id", 5, 0).toPandas()
    areas = sorted(hot["area"].unique())
    x = np.array([[float(a == b) for b in areas] for a in hot["area"]])
    for alpha in (1e-4, 1e-2, 100.0):
        one = {r["id"]: r["coefficient"] for r in M.area_effects(df, "area", ["x"], "y", "id", "w", [alpha]).collect()}
        scores[alpha] = one
    frame = spark.createDataFrame([(*map(float, row), y, w, int(f)) for row, y, w, f in zip(x, hot["y"], hot["w"], hot["fold"])], ", ".join([*(f"{a} double" for a in areas), "y double", "w double", "fold int"]))
    best = R.lasso_cv(frame, areas, "y", "fold", [1e-4, 1e-2, 100.0], "w")
    assert {r["id"]: r["coefficient"] for r in got} == pytest.approx(scores[best["alpha"]])
    first = {}
    for i, a, _, _, place in rows:
        first.setdefault(a, place)
    assert {r["id"]: r["x"] for r in got} == first


def test_logistic_steps_do_not_repeat_the_source(spark, frame):
    """However many Newton steps there are, the given rows are made once."""
    data = frame.dropna().withColumn("z", (F.col("y") > 22).cast("double"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(a):
        seen.add(1)
        return a

    plain = R.logistic_cv(data, ["a", "b"], "z", "fold", 5, strengths=(0.1, 1.0))
    got = R.logistic_cv(data.withColumn("a", counted("a")), ["a", "b"], "z", "fold", 5, strengths=(0.1, 1.0))
    assert got["C"] == plain["C"] and got["r2"] == pytest.approx(plain["r2"])
    assert seen.value == got["rows"]
