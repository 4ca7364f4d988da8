import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from welfarelens.operators import distribution as D, ordered as O, poverty as P
from welfarelens.sources.readers import nan_to_null

EDGE = [
    ("a", 1.0, 2.0), ("a", 2.15, 1.0), ("a", None, 3.0), ("a", 5.0, 0.0), ("a", 0.5, None),
    ("b", 4.0, 1.0), ("c", None, 2.0), (None, 1.0, 1.0),
]


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(EDGE, "g string, y double, w double")


def test_poverty_edges(edge):
    rows = {r["g"]: r for r in P.poverty_table(edge, "y", "w", 2.15, ["g"]).collect()}
    # at the line is not poor; a missing outcome counts in the denominator only
    assert rows["a"]["poverty_rate"] == pytest.approx(2 / 6)
    assert rows["a"]["poverty_gap"] == pytest.approx(2 * 1.15 / 6)
    assert rows["b"]["poverty_rate"] == 0.0
    assert rows["c"]["poverty_rate"] == 0.0 and rows["c"]["poverty_gap"] == 0.0
    assert set(rows) == {"a", "b", "c"}  # no row for an unknown group


def test_poverty_at_lines_agrees_with_single_line(edge):
    many = P.poverty_at_lines(edge.filter("w IS NOT NULL"), "y", "w", [1.0, 2.15, 9.0], ["g"]).collect()
    for r in many:
        one = P.poverty_table(edge.filter("w IS NOT NULL"), "y", "w", r["line"], ["g"])
        want = [x for x in one.collect() if x["g"] == r["g"]][0]
        assert r["poverty_rate"] == pytest.approx(want["poverty_rate"])
        assert r["poverty_gap"] == pytest.approx(want["poverty_gap"])


def test_nan_is_null_on_load(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "y double"))
    assert sorted(r[0] is None for r in df.collect()) == [False, True]


def brute_quantile(pairs, p):
    merged = {}
    for v, w in pairs:
        merged[v] = merged.get(v, 0) + w
    total, seen = sum(merged.values()), 0.0
    keys = sorted(merged)
    for i, v in enumerate(keys):
        seen += merged[v]
        if abs(seen - p * total) < 1e-9 and i + 1 < len(keys):
            return (v + keys[i + 1]) / 2
        if seen >= p * total - 1e-9:
            return v


def test_weighted_quantile_against_brute_force(spark):
    rng = random.Random(3)
    # a third of the rows share one value and most rows are in one group
    data = [
        ("hot" if rng.random() < 0.7 else f"g{i % 5}", 7.0 if rng.random() < 0.33 else rng.randint(0, 400) / 4,
         rng.randint(0, 4) / 2)
        for i in range(3000)
    ]
    df = spark.createDataFrame(data, "g string, y double, w double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in D.weighted_quantile(df, "y", "w", probs, ["g"], buckets=16).collect()}
    groups = {g for g, _, _ in data}
    assert len(got) == len(groups) * len(probs)
    for g in groups:
        pairs = [(y, w) for k, y, w in data if k == g and w > 0]
        for p in probs[1:]:
            assert got[(g, p)] == pytest.approx(brute_quantile(pairs, p)), (g, p)


def test_weighted_quantile_toy_and_floor(spark):
    df = spark.createDataFrame([(-5.0, 1.0), (1.0, 1.0), (10.0, 1.0), (11.0, 1.0)], "y double, w double")
    got = [r["quantile"] for r in D.weighted_quantile(df, "y", "w", [0.1, 0.25, 0.6]).orderBy("prob").collect()]
    assert got == [0.0, 0.0, 10.0]  # -5 floored; exact hit (-5 + 1) / 2 floored; third value


def test_running_totals_with_null_group_and_few_values(spark):
    df = spark.createDataFrame(
        [(None, 1.0, 1.0), (None, 2.0, 1.0), ("a", 2.0, 5.0), ("a", 2.0, 1.0), ("a", None, 9.0), ("a", float("nan"), 9.0)],
        "g string, v double, w double",
    )
    got = {(r["g"], r["v"]): (r["cum_w"], r["all_w"]) for r in O.running_totals(
        df, "v", {"w": F.sum("w")}, ["g"], buckets=4, with_totals=True).collect()}
    assert got == {("a", 2.0): (6.0, 6.0)}


def test_running_totals_do_not_depend_on_buckets(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randint(0, 50) - 25.0, 1.0) for _ in range(500)], "v double, w double")
    one, many = (
        sorted(map(tuple, O.running_totals(df, "v", {"w": F.sum("w")}, buckets=b).collect())) for b in (2, 64)
    )
    assert one == many
    assert one[-1][-1] == 500.0


def test_interval_index_and_negative_zero(spark):
    df = spark.createDataFrame([(-0.0,), (0.0,), (1.0,), (-1.0,), (None,)], "v double")
    got = [r["i"] for r in O.interval_index(df, "v", [-0.0, 1.0], "i").collect()]
    assert got == [1, 1, 2, 0, 3]


def test_last_at_or_below(spark):
    df = spark.createDataFrame([("a", 0.0, 1), ("a", 2.0, 2), ("a", 5.0, 3)], "g string, k double, p int")
    groups = spark.createDataFrame([("a",), ("none",)], "g string")
    got = {(r["g"], r["threshold"]): r["p"] for r in O.last_at_or_below(df, "k", "k", [-1.0, 0.0, 2.0, 4.9, 99.0], ["p"], ["g"], groups).collect()}
    assert [got[("a", t)] for t in (-1.0, 0.0, 2.0, 4.9, 99.0)] == [None, 1, 2, 2, 3]
    assert got[("none", 2.0)] is None


def test_variance_parts_add_up(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice("abc"), rng.random()) for _ in range(200)], "g string, x double")
    r = D.variance_decomposition(df, "x", "g").first()
    assert r["var_within"] + r["var_between"] == pytest.approx(r["var_total"])
    assert r["var_total"] == pytest.approx(np.var([x[1] for x in df.collect()], ddof=1))


def test_entropy(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (3.0,), (None,)], "v double")
    r = D.entropy(df, "v").first()
    p = [0.5, 0.25, 0.25]
    assert r["entropy"] == pytest.approx(-sum(x * math.log(x) for x in p))
    assert r["uniform_entropy"] == pytest.approx(math.log(5)) and r["distinct_values"] == 3


def test_histogram_maximum_and_constant(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    got = dict(map(tuple, D.histogram(df, "v", 5).collect()))
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3}
    one = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [tuple(r) for r in D.histogram(one, "v", 5).collect()] == [(1, 2)]


def test_standardize_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    got = D.standardize(df, ["a", "b"]).collect()
    assert [round(r["a"], 6) for r in got] == [-0.707107, 0.707107, 0.0]
    assert {r["b"] for r in got} == {0.0}


def test_intermediate_tables_can_be_dropped(spark):
    import os

    from welfarelens import session

    held = session.written_once(spark.range(5).toDF("x"))
    folder = session._INTERMEDIATES[spark.sparkContext.applicationId][-1].removeprefix("file:")
    assert held.count() == 5 and os.path.isdir(folder)
    assert session.drop_intermediates(spark) >= 1 and not os.path.exists(folder)
    assert session.drop_intermediates(spark) == 0
