import pytest

from pyspark.sql import functions as F
from welfarelens.functions import money as M
from welfarelens.operators import panel as P

SERIES = "e string, y int, h double, g double"


def test_latest_row_is_not_latest_value(spark):
    s = spark.createDataFrame(
        [("a", 2000, 0.5, 0.1), ("a", 2005, None, 0.2), ("b", 2001, None, 0.3), (None, 2001, 0.5, 0.3)], SERIES
    )
    got = {r["e"]: r for r in P.latest_row(s, "e", "y", ["h", "g"]).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["latest_h"] is None and got["a"]["latest_h_year"] == 2005  # last row, although empty
    assert got["b"]["latest_h"] is None and got["b"]["latest_h_year"] is None  # never a value
    assert got["b"]["latest_g_year"] == 2001


def test_latest_non_null_keeps_empty_rows(spark):
    w = spark.createDataFrame([("a", 1.0, None, 3.0, None), ("b", None, None, None, None)], "e string, `2000` double, `2001` double, `2002` double, `2003` double")
    got = {r["e"]: (r["v"], r["v_year"]) for r in P.latest_non_null(w, "v", scale=2.0).collect()}
    assert got == {"a": (6.0, 2002), "b": (None, None)}


CASES = [
    # entity, year -> headcount, gap, method
    ("a", 2002, 0.4, 0.04, "exact year"),
    ("a", 2003, 0.35, 0.035, "interpolated using 2002 and 2004"),
    ("a", 1990, 0.6, 0.06, "from nearest year: 2000"),
    ("a", 2020, 0.1, None, "from nearest year: 2008"),
    ("a", 2006, 0.2, None, "interpolated using 2004 and 2008"),
    ("a", 2005, None, 0.9, "exact year"),  # an empty exact year is used as it is
    ("b", 2000, None, None, "no data available"),
    ("z", 2000, None, None, "no data available"),
    (None, 2000, None, None, "no data available"),
]


def test_estimate_at_year(spark):
    s = spark.createDataFrame(
        [("a", 2000, 0.6, 0.06), ("a", 2002, 0.4, 0.04), ("a", 2004, 0.3, 0.03), ("a", 2005, None, 0.9), ("a", 2008, 0.1, None),
         ("b", 1999, None, 0.5)], SERIES,
    )
    q = spark.createDataFrame([(c[0], c[1]) for c in CASES] * 2, "e string, t int")
    got = P.estimate_at_year(q, "e", "t", s, "e", "y", ["h", "g"]).collect()
    assert len(got) == 2 * len(CASES)  # repeated queries stay
    rows = {(r["e"], r["t"]): r for r in got}
    for e, t, h, g, method in CASES:
        r = rows[(e, t)]
        assert r["method"] == method
        for have, want in ((r["h"], h), (r["g"], g)):
            assert have is None if want is None else have == pytest.approx(want)


def test_lookup_year(spark):
    w = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, None)], "k string, `2000` double, `2001` double")
    q = spark.createDataFrame([("a", 2001), ("b", 2001), ("b", 1999), ("c", 2000), ("a", None)], "e string, t int")
    got = {(r["e"], r["t"]): r["v"] for r in P.lookup_year(q, "e", "t", w, "k", "v", 10.0).collect()}
    both = P.lookup_year(q.withColumn("2000", F.lit(5)), "e", "t", w, "k", "v", 10.0)  # year columns on both sides
    assert {(r["e"], r["t"]): r["v"] for r in both.collect()} == got and {r["2000"] for r in both.collect()} == {5}
    assert got == {("a", 2001): 20.0, ("b", 2001): None, ("b", 1999): None, ("c", 2000): None, ("a", None): None}


def test_fractional_year_and_fallback(spark):
    w = spark.createDataFrame([(2000.25, 10.0, 20.0), (2001.0, 10.0, 20.0), (2024.0, 10.0, 20.0)], "t double, `2000` double, `2001` double")
    c = P.value_at_fractional_year("t", ["2000", "2001"], {2024: 2001})
    assert [r[0] for r in w.select(c).collect()] == [12.5, 20.0, 20.0]


def test_impute_override_donor(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", None), (None, None)], "k string, v double")
    other = spark.createDataFrame([("a", 9.0), ("b", 8.0)], "k string, o double")
    assert {r["k"]: r["v"] for r in P.impute_from(base, other, "k", {"v": "o"}).collect()} == {"a": 1.0, "b": 8.0, None: None}
    assert {r["k"]: r["v"] for r in P.override_from(base, other, "k", {"v": "o"}).collect()} == {"a": 9.0, "b": 8.0, None: None}
    donors = spark.createDataFrame([("b", "a"), ("a", "zz")], "target string, donor string")
    assert {r["k"]: r["v"] for r in P.donor_copy(base, "k", donors, ["v"]).collect()} == {"a": None, "b": 1.0, None: None}


def test_ratio_extrapolation(spark):
    s = spark.createDataFrame([("a", "A", 2000, 6.0), ("a", "B", 2000, 3.0), ("a", "B", 2010, 5.0), ("b", "A", 2000, 1.0), ("b", "B", 2000, 0.0), ("b", "B", 2010, 2.0)], "e string, n string, y int, v double")
    rules = spark.createDataFrame([(e, "A", "B", 2000, 2010) for e in "abc"], "entity string, series string, base string, from_year int, to_year int")
    got = {r["entity"]: r["estimate"] for r in P.ratio_extrapolation(s, "e", "n", "y", "v", rules).collect()}
    assert got == {"a": 10.0, "b": None, "c": None}


def test_gap_fill(spark):
    s = spark.createDataFrame([("w", 2000, 1.0), ("w", 2001, None), ("w", 2002, 3.0), ("w", 2003, 7.0), ("w", 2004, None)], "e string, y int, v double")
    got = [r["v"] for r in P.fill_between_and_ahead(s, "e", "y", "v").orderBy("y").collect()]
    assert got == [1.0, 2.0, 3.0, 7.0, 11.0]


def test_money(spark):
    p = spark.createDataFrame(
        [(10.0, "2", "50 KG. BAG"), (3.0, "2", "KILOGRAMME"), (9.0, "1", "90 KG. BAG"), (9.0, "x", "KILOGRAMME"), (9.0, "1.5", "KILOGRAMME"), (9.0, "1", "PAIL")],
        "price double, q string, u string",
    )
    got = [r[0] for r in p.select(M.price_per_50_kg("price", "q", "u")).collect()]
    assert got[:3] == pytest.approx([5.0, 75.0, 5.0]) and got[3:] == [None, None, None]
    w = spark.createDataFrame([(1.0, 0.0), (2.0, 0.5), (None, 0.0)], "s double, h double")
    assert [r[0] for r in w.select(M.shortfall_to_population_gap("s", "h")).collect()] == [0.0, 1.0, 0.0]
    table = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 3.0)], "k string, f double")
    assert M.single_factor(table, "k", "a", "f") == 2.0
    for bad in ("b", "c"):
        with pytest.raises(ValueError):
            M.single_factor(table, "k", bad, "f")
    hh = spark.createDataFrame([(730.0, 2.0, 0.5)], "dtot double, n double, x_def_temp_prix2017 double")
    assert M.deflated_consumption(hh, "dtot", "n", 3.0).first()["consumption_per_capita_per_day"] == pytest.approx(6.0)
    with pytest.raises(ValueError):
        M.deflator_column(hh.drop("x_def_temp_prix2017"))


def test_index_and_share(spark):
    s = spark.createDataFrame([(2000, 4.0), (2001, 6.0)], "year int, v double")
    assert [r["v"] for r in P.index_to_base_year(s, "year", "v", 2000).orderBy("year").collect()] == [1.0, 1.5]
    assert [r["year"] for r in P.year_spine(s, "year", 2003).orderBy("year").collect()] == [2000, 2001, 2002, 2003]
    part = spark.createDataFrame([(2000, 1.0), (1999, 1.0)], "year int, p double")
    got = {r["year"]: r["share"] for r in P.share_of_total(part, s, "year", "p", "v", "share").collect()}
    assert got == {2000: 0.25, 1999: None}
