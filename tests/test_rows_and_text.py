import pytest
from pyspark.sql import functions as F

from welfarelens.functions import learning as L, text as X
from welfarelens.operators import dedup as U, encode as E, quality as Q


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [("  Côte d’Ivoire ", "cote d’ivoire"), ("São Tomé", "sao tome"), ("ﬁn ½", "fin 1⁄2"), ("\tABC ", "abc"), (None, None), ("", ""),
     ("한국", "한국"), ("Straße", "straße")],
)
def test_normalize_text(spark, raw, want):
    assert one(spark, raw, X.normalize_text) == want


def test_slug_and_key(spark):
    alias = {"yemen_republic_of": "yemen, rep."}
    assert one(spark, "Côte d'Ivoire", X.slug) == "cote_divoire"
    assert one(spark, "Yemen, Republic of", lambda c: X.slug(c, alias)) == "yemen, rep."
    assert one(spark, "  Côte   d'Ivoire ", X.country_key) == "cote_divoire"
    assert one(spark, "burkina faso", X.country_key) == one(spark, "Burkina_Faso", X.country_key).replace(" ", "_")


def test_fixes_run_in_order(spark):
    fixes = [("Niger ", "Niger"), ("Ivory", "Côte d’Ivoire"), ("Côte", "CIV")]
    assert one(spark, "Ivory Coast", lambda c: X.fix_containing(c, fixes)) == "CIV"
    assert one(spark, "Nigeria", lambda c: X.fix_containing(c, fixes)) == "Nigeria"
    assert one(spark, None, lambda c: X.fix_containing(c, fixes)) is None


def test_maps_percent_truncate(spark):
    assert one(spark, "x", lambda c: X.replace_values(c, {"a": "b"})) == "x"
    assert one(spark, "x", lambda c: X.map_values(c, {"a": "b"})) is None
    assert one(spark, "12%", X.percent_to_fraction) == pytest.approx(0.12)
    assert one(spark, "n/a", X.percent_to_fraction) is None
    assert one(spark, "abcdefgh", lambda c: X.truncate(c, 6)) == "abc..."
    assert one(spark, "abcdef", lambda c: X.truncate(c, 6)) == "abcdef"
    assert X.feature_column_name(".12", "f") == "f_12" and X.feature_column_name("", "f") == "f_0"
    assert X.feature_column_name("Lat", "f") == "Lat"
    df = spark.createDataFrame([("a", None)], "a string, b int")
    assert df.select(X.strata_key("a", "b")).first()[0] == "a-nan"


def test_losses(spark):
    df = spark.createDataFrame([(1.0, 3.0), (5.0, 3.0), (3.0, 3.0), (None, 3.0)], "y double, q double")
    assert [r[0] for r in df.select(L.pinball_loss("y", "q", 0.25)).collect()] == [1.5, 0.5, 0.0, None]
    assert [r[0] for r in df.select(L.below_estimate("y", "q")).collect()] == [True, False, False, None]
    assert [r[0] for r in df.select(L.below_estimate("y", "q", closed=True)).collect()] == [True, False, True, None]


def test_dedup_null_keys_and_missing_columns(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 1, "u"), (None, 2, "v")], "k string, i int, v string")
    assert {r["k"]: r["v"] for r in U.keep_first(df, ["k"], ["i"]).collect()} == {"a": "x", None: "u"}
    assert {r["k"]: r["v"] for r in U.keep_last(df, ["k", "nope"], ["i"]).collect()} == {"a": None, None: "v"}


def test_conflicts(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 1.0, 2.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 1.0, 1.0)], "k string, x double, y double")
    assert {r["k"]: r["conflicts"] for r in U.conflicting_duplicates(df, ["k"], ["x", "y"]).collect()} == {"b": "x"}
    with pytest.raises(ValueError):
        U.resolve_duplicates(df, ["k"], ["x"], ["x"])
    assert U.resolve_duplicates(df, ["k"], ["y"], ["x"]).count() == 3
    assert {r["k"] for r in U.duplicate_keys(df, ["k"]).collect()} == {"a", "b"}


def test_one_hot_pair_align_and_inverse(spark):
    train = spark.createDataFrame([(1, "x", 7), (2, None, 8)], "id int, c string, n int")
    test = spark.createDataFrame([(3, "y", 9)], "id int, c string, n int")
    a, b = E.one_hot_pair(train, test, ["c", "n"])
    assert a.columns == b.columns == ["id", "c_x", "c_y", "n_7", "n_8", "n_9"]
    assert [tuple(r) for r in a.collect()] == [(1, 1.0, 0.0, 1.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 1.0, 0.0)]
    back = E.inverse_one_hot(a, {"c_x": ("c", "x"), "c_y": ("c", "y")})
    assert {r["id"]: r["c"] for r in back.collect()} == {1: "x", 2: None}
    only = E.one_hot(train, {"c": ["x"]})
    assert E.align_columns(only, ["id", "c_x", "c_z"]).first()["c_z"] == 0.0


def test_category_limit_is_an_error(spark):
    df = spark.range(20).selectExpr("cast(id as string) as c")
    with pytest.raises(ValueError):
        E.category_lists(df, ["c"], limit=10)
    sparse = E.sparse_one_hot(df, ["c"])
    assert sparse.first()["encoded"].size == 20 and sparse.count() == 20


def test_category_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "c string")
    assert [r["c"] for r in E.category_codes(df, ["c"]).collect()] == [1, 0, -1, 2]


def test_large_category_codes(spark):
    import random

    rng = random.Random(6)
    words = [f"prefix_{rng.randint(0, 400)}é" if i % 3 else None for i in range(900)] + ["prefix_", "prefix_zz"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, c string")
    order = {v: k for k, v in enumerate(sorted({w for w in words if w}, key=lambda w: w.encode()))}
    got = {r["i"]: r["c"] for r in E.category_codes(df, ["c"]).collect()}
    assert got == {i: order.get(w, -1) for i, w in enumerate(words)}


def test_category_codes_of_numbers(spark):
    df = spark.createDataFrame([(10, 1.5), (2, None), (None, -3.0), (10, 1e9)], "n int, x double")
    got = E.category_codes(df.withColumn("i", df["n"] * 1), ["n", "x"]).collect()
    assert sorted((r["i"] or 0, r["n"], r["x"]) for r in got) == [(0, -1, 0), (2, 0, -1), (10, 1, 1), (10, 1, 2)]


def test_keep_without_any_key(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    with pytest.raises(ValueError, match="none of the key columns"):
        U.keep_first(df, ["nope"], ["a"])


def test_metadata_projection(spark):
    meta = spark.createDataFrame(
        [("d", "categorical", True, False), ("r", "categorical", True, True), ("x", "numeric", False, None)],
        "variable_name string, data_type string, geographic_indicator boolean, geographic_indicator_coarser boolean",
    )
    df = spark.createDataFrame([("a", "b", 1.0, "id1")], "d string, r string, x double, hhid string")
    assert E.drop_fine_geography(df, meta).columns == ["r", "x", "hhid"]
    assert E.drop_ids(df).columns == ["d", "r", "x"]
    assert E.categorical_columns(meta, df) == ["d", "r"]
    old = spark.createDataFrame([("cov", ["d", "x"]), ("other", ["r"])], "covariate string, columns array<string>")
    assert E.select_covariates(df, old, ["other", "cov"], ["hhid"]).columns == ["r", "d", "x", "hhid"]
    with pytest.raises(ValueError):
        E.select_covariates(df, old, ["cov"], ["hhid"], F.col("d") == "zzz")
    with pytest.raises(KeyError):
        E.select_covariates(df, old, ["nope"], ["hhid"])
    dates = spark.sql("SELECT 1 AS a, 'x' AS b, current_date() AS c, 1.0D AS d_nan")
    assert E.numeric_and_categorical(dates) == (["a"], ["b", "d_nan"])


def test_quality_checks(spark):
    meta = spark.createDataFrame(
        [("x", "numeric", True, 0.0, "unit of x"), ("bad", "text", True, 2.0, None), ("code_a", "numeric", False, None, "religion")],
        "variable_name string, data_type string, geographic_indicator boolean, geographic_indicator_coarser double, variable_description string",
    )
    found = {tuple(r) for r in Q.invalid_metadata(meta).collect()}
    assert found == {("bad", "data_type", "text"), ("bad", "geographic_indicator_coarser", "2.0")}
    with pytest.raises(ValueError):
        Q.require_valid_metadata(meta)
    assert {tuple(r) for r in Q.suspicious_variables(meta).collect()} == {
        ("x", "unit"), ("code_a", "demographic"), ("code_a", "numeric id or code")
    }
    df = spark.createDataFrame([("a", 1.0, 2.0, 2.0), ("a", None, 2.0, 4.0)], "hhid string, y double, hh_size double, w double").withColumn("hh_wgt", F.lit(1.0))
    got = dict(map(tuple, Q.survey_findings(df, "y", "w").collect()))
    assert got == {"null_outcome": 1, "null_weight": 0, "size_times_weight": 1, "duplicate_id": 2}
    with pytest.raises(ValueError):
        Q.survey_findings(df, "hhid", "w")
    with pytest.raises(ValueError):
        Q.survey_findings(df, "nope", "w")


def test_changed_rows_nulls_equal(spark):
    new = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0), (None, 5.0)], "k string, v double")
    old = spark.createDataFrame([("a", 1.0 + 1e-9), ("b", None), ("d", 3.0), (None, 5.0)], "k string, v double")
    assert {tuple(r) for r in Q.changed_rows(new, old, "k", "v").collect()} == {("c", 2.0, None), ("d", None, 3.0)}


def test_equivalent_columns(spark):
    rows = [(float(i % 7), float(i % 7) * 2, i % 3, "xyz"[i % 3], None if i % 5 == 0 else float(i), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c int, d string, e double, k int")
    got = {(r["column_a"], r["column_b"]): r["relation"] for r in Q.equivalent_columns(df, ["a", "b", "e"], ["c", "d", "k"]).collect()}
    assert got == {("a", "b"): "proportional", ("c", "d"): "one_to_one", ("k", None): "constant"}


def test_group_mode_lowest_on_ties_and_first(spark):
    df = spark.createDataFrame([("g", 2, 5.0), ("g", 1, 5.0), ("g", 3, 1.0), ("g", 4, 1.0), ("h", 1, None), ("h", 2, 8.0)], "g string, i int, v double")
    assert {r["g"]: r["v"] for r in Q.group_mode(df, "g", ["v"]).collect()} == {"g": 1.0, "h": 8.0}
    assert {r["g"]: r["v"] for r in Q.group_first(df, "g", ["v"], "i").collect()} == {"g": 5.0, "h": 8.0}
