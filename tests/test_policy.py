import random

import numpy as np
import pytest

from welfarelens.operators import curves as C, policy as P

LINE = 2.15


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    return [(rng.choice(["a", "b"]), rng.lognormvariate(0.6, 0.9), rng.randint(1, 8) / 4) for _ in range(800)]


@pytest.fixture(scope="module")
def hh(spark, data):
    return spark.createDataFrame(data + [("a", None, 1.0)], "g string, y double, w double")


def metrics(y, w, t, n):
    after = y + t
    return (
        (w * (after < LINE)).sum() / n, (w * np.maximum(LINE - after, 0)).sum() / n, (w * t).sum() / n
    )


def arrays(data, g):
    y = np.array([r[1] for r in data if r[0] == g])
    w = np.array([r[2] for r in data if r[0] == g])
    return y, w, w.sum() + (1.0 if g == "a" else 0.0)


def test_uniform_transfer(hh, data):
    for r in P.uniform_transfer(hh, "y", "w", LINE, [0.0, 0.3, 2.5], ["g"]).collect():
        y, w, n = arrays(data, r["g"])
        rate, gap, _ = metrics(y, w, r["budget"], n)
        assert r["post_transfer_poverty_rate"] == pytest.approx(rate)
        assert r["post_transfer_poverty_gap"] == pytest.approx(gap, abs=1e-12)
        assert r["policy_cost_per_capita"] == r["budget"]


def test_oracle_gap_spends_the_budget(hh, data):
    out = P.oracle_gap(hh, "y", "w", LINE, [0.0, 0.05, 0.2, 5.0], ["g"]).collect()
    for r in out:
        y, w, n = arrays(data, r["g"])
        t = np.maximum(r["floor"] - y, 0) if r["floor"] is not None else 0 * y
        rate, gap, cost = metrics(y, w, t, n)
        assert cost == pytest.approx(r["policy_cost_per_capita"], abs=1e-12)
        assert gap == pytest.approx(r["post_transfer_poverty_gap"], abs=1e-12)
        full = r["initial_poverty_gap"]
        assert r["post_transfer_poverty_gap"] == pytest.approx(max(full - r["budget"], 0))
        if r["budget"] >= full:
            assert r["post_transfer_poverty_rate"] == 0.0 and r["policy_cost_per_capita"] == pytest.approx(full)
        else:
            assert r["post_transfer_poverty_rate"] == r["initial_poverty_rate"]


def test_oracle_gap_on_data_costs_at_most_the_budget(hh):
    exact = {(r["g"], r["budget"]): r for r in P.oracle_gap(hh, "y", "w", LINE, [0.05, 0.2], ["g"]).collect()}
    for r in P.oracle_gap(hh, "y", "w", LINE, [0.05, 0.2], ["g"], floor_on_data=True).collect():
        assert r["policy_cost_per_capita"] <= r["budget"]
        assert r["floor"] <= exact[(r["g"], r["budget"])]["floor"]


def test_oracle_rate(hh, data):
    for r in P.oracle_rate(hh, "y", "w", LINE, [0.0, 0.1, 0.9], ["g"]).collect():
        y, w, n = arrays(data, r["g"])
        order = np.argsort(y)
        kept, seen = np.zeros(len(y), bool), 0.0
        for i in order:
            if y[i] < LINE and (seen + w[i]) / n <= r["tolerance"]:
                kept[i], seen = True, seen + w[i]
            else:
                break
        t = np.where((y < LINE) & ~kept, LINE - y, 0)
        assert r["post_transfer_poverty_rate"] == pytest.approx(w[kept].sum() / n)
        assert r["policy_cost_per_capita"] == pytest.approx((w * t).sum() / n)
        assert r["post_transfer_poverty_rate"] <= r["tolerance"] + 1e-12


def test_binary_and_ranked_agree_when_ranked_by_outcome(hh):
    a = P.binary_transfer(hh, "y", "w", LINE, [0.7], [0.05, 0.1], ["g"]).collect()
    poor = hh.filter("y < 2.15 OR y IS NULL")
    b = {(r["g"], r["budget"]): r for r in P.ranked_transfer(hh, "y", "w", "y", LINE, 0.7, [0.05, 0.1], ["g"]).collect()}
    assert poor.count() > 0
    for r in a:
        other = b[(r["g"], r["budget"])]
        assert r["post_transfer_poverty_gap"] == pytest.approx(other["post_transfer_poverty_gap"])
        assert r["post_transfer_poverty_rate"] == pytest.approx(other["post_transfer_poverty_rate"])
        assert r["policy_cost_per_capita"] <= r["budget"] + 1e-12


def test_group_without_poor(spark):
    df = spark.createDataFrame([("rich", 9.0, 1.0), ("poor", 1.0, 1.0)], "g string, y double, w double")
    for fn, grid in ((P.oracle_gap, [0.5]), (P.oracle_rate, [0.5])):
        rows = {r["g"]: r for r in fn(df, "y", "w", LINE, grid, ["g"]).collect()}
        assert rows["rich"]["post_transfer_poverty_gap"] == 0 and rows["rich"]["policy_cost_per_capita"] == 0


def test_oracle_is_never_dearer_than_uniform(hh):
    ubi = P.uniform_transfer(hh, "y", "w", LINE, [0.1, 0.5], ["g"]).collect()
    oracle = {(r["g"], r["budget"]): r for r in P.oracle_gap(hh, "y", "w", LINE, [0.1, 0.5], ["g"]).collect()}
    for r in ubi:
        assert oracle[(r["g"], r["budget"])]["post_transfer_poverty_gap"] <= r["post_transfer_poverty_gap"] + 1e-12


def test_evaluate_transfer_matches_log_relation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0)], "y double, w double")
    r = P.evaluate_transfer(df.selectExpr("y", "w", "1.15D AS t"), "y", "w", "t", LINE).first()
    assert r["initial_poverty_rate"] == 0.25 and r["policy_cost_per_capita"] == pytest.approx(1.15)
    assert r["post_transfer_poverty_rate"] == 0.0  # lifted exactly to the line


def test_interpolation_like_numpy(spark):
    xs, fs = [0.0, 1.0, 4.0, 9.0], [3.0, 1.0, 2.0, -4.0]
    at = [-1.0, 0.0, 0.25, 1.0, 2.0, 8.9, 9.0, 20.0]
    df = spark.createDataFrame([("c", x, f) for x, f in zip(xs, fs)] + [("c", None, 1.0)], "k string, x double, f double")
    got = [r["f"] for r in C.interpolate(df, "x", "f", at, ["k"]).orderBy("x").collect()]
    assert got == pytest.approx(list(np.interp(at, xs, fs)))


def test_interpolation_with_repeated_x_and_one_point(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 1.0, 7.0), ("a", 2.0, 9.0), ("b", 3.0, 4.0)], "k string, x double, f double")
    got = {(r["k"], r["x"]): r["f"] for r in C.interpolate(df, "x", "f", [0.0, 1.0, 1.5], ["k"]).collect()}
    assert got == {("a", 0.0): 5.0, ("a", 1.0): 7.0, ("a", 1.5): 8.0, ("b", 0.0): 4.0, ("b", 1.0): 4.0, ("b", 1.5): 4.0}


def test_hyperparameters_and_bound(spark):
    t = spark.createDataFrame(
        [(1, 0.1, 5.0), (1, 0.1, 3.0), (2, 0.1, 4.0), (2, 0.2, None), (None, 0.2, 0.0)], "n int, lr double, loss double"
    )
    r = C.pick_hyperparameters(t, ["n", "lr"], "loss").first()
    assert (r["n"], r["lr"], r["mean_loss"]) == (1, 0.1, 4.0)
    runs = spark.createDataFrame([(0.5, 0.005, 2.0), (0.7, 0.009, 1.0), (0.2, 0.5, 0.1)], "budget double, rate double, cost double")
    assert C.cheapest_under_bound(runs, "rate", 0.01, "cost", "budget").first()["budget"] == 0.7


def test_subnational_table_has_null_instead_of_infinity(spark):
    row = [(0.5, 0.3, 0.3, 0.5, 0.1, 10.0)]
    df = spark.createDataFrame(row, "initial_poverty_rate double, initial_poverty_gap double, post_transfer_poverty_gap double, post_transfer_poverty_rate double, policy_cost_per_capita double, n double")
    r = P.subnational_table(df, "n").first()
    assert r["total_cost"] == pytest.approx(1.0) and r["cost_per_poverty_count_reduction"] is None
