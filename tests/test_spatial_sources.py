import math
import os
import random

import pytest
from pyspark.sql import functions as F

from welfarelens.operators import skew, spatial as G
from welfarelens.sources import readers as I, writers as O


def brute_nearest(left, right, limit=None):
    out = set()
    for a in set(left):
        d = {b: (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) for b in set(right)}
        best = min(d.values())
        if limit is None or best**0.5 <= limit:
            out |= {(*a, *b) for b, v in d.items() if v == best}
    return out


def cloud(seed, n):
    """A third of the points sit in one tiny cluster, some on exact grid positions, some repeated."""
    rng = random.Random(seed)
    pts = []
    for _ in range(n):
        k = rng.random()
        if k < 0.35:
            pts.append((3 + rng.random() * 1e-4, 4 + rng.random() * 1e-4))
        elif k < 0.7:
            pts.append((float(rng.randint(0, 8)), float(rng.randint(0, 8))))
        else:
            pts.append((rng.uniform(-2, 10), rng.uniform(-2, 10)))
    return pts


@pytest.mark.parametrize("limit", [None, 0.3])
def test_nearest_against_brute_force(spark, limit):
    left, right = cloud(1, 300), cloud(2, 400)
    a = spark.createDataFrame(left, "x double, y double")
    b = spark.createDataFrame(right, "x double, y double")
    got = G.nearest_locations(a, b, limit, leaf=4).collect()
    assert {(r["lx"], r["ly"], r["rx"], r["ry"]) for r in got} == brute_nearest(left, right, limit)
    assert len(got) == len(brute_nearest(left, right, limit))


@pytest.mark.parametrize("limit", [None, 0.3])
def test_nearest_in_a_tree_that_is_not_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(G, "BROADCAST_LOCATIONS", 10)
    monkeypatch.setattr(G, "BROADCAST_LEVEL", 2)
    monkeypatch.setattr(skew, "CROWD", 5)
    left, right = cloud(5, 300), cloud(6, 400)
    got = G.nearest_locations(spark.createDataFrame(left, "x double, y double"), spark.createDataFrame(right, "x double, y double"), limit, leaf=4).collect()
    assert {(r["lx"], r["ly"], r["rx"], r["ry"]) for r in got} == brute_nearest(left, right, limit)
    assert len(got) == len(brute_nearest(left, right, limit))


def rows_by_task(spark, df):
    """Rows of every task of the last stage, without the engine's own balancing."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_few_locations_and_a_crowded_cell_spread_over_tasks(spark, monkeypatch):
    few = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0), (9.0, 0.0)], "x double, y double")
    sites = spark.range(200_000, numPartitions=8).select((F.rand(1) * 9).alias("x"), (F.rand(2) * 9).alias("y"))
    sizes = rows_by_task(spark, G.nearest_locations(sites, few))
    assert sum(sizes) == 200_000 and len(sizes) == 4 and max(sizes) < 1.2 * 50_000
    # many locations, not broadcast, and all sites in one cell
    monkeypatch.setattr(G, "BROADCAST_LOCATIONS", 100)
    monkeypatch.setattr(skew, "CROWD", 1000)
    grid = spark.range(3000).select((F.col("id") % 60).cast("double").alias("x"), F.floor(F.col("id") / 60).cast("double").alias("y"))
    tight = spark.range(40_000, numPartitions=8).select((7.2 + F.rand(3) / 100).alias("x"), (7.2 + F.rand(4) / 100).alias("y"))
    found = G.nearest_locations(tight, grid)
    assert found.filter("rx = 7 and ry = 7").count() == found.count() == 40_000
    assert max(rows_by_task(spark, found)) < 1.2 * 10_000


def test_split_join_cuts_crowded_keys(spark):
    many = spark.range(50_000, numPartitions=8).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("k"))
    few = spark.createDataFrame([(k % 100, f"n{k}") for k in range(150)], "key long, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = skew.split_join(many, few, ["k"], ["key"], ["id"], crowd=500)
        assert max(rows_by_task(spark, met)) < 1.5 * met.count() / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = many.join(few, F.col("k") == F.col("key")).select("id", "k", "name")
    assert met.columns == ["id", "k", "name"] and met.exceptAll(want).isEmpty() and want.exceptAll(met).isEmpty()


def test_nearest_join_keeps_ties_and_unmatched(spark):
    a = spark.createDataFrame([("p", 0.0, 0.0), ("q", 50.0, 0.0), ("n", None, 0.0)], "id string, x double, y double")
    b = spark.createDataFrame([(1, 1.0, 0.0), (2, -1.0, 0.0), (3, 0.0, 3.0)], "t int, u double, v double")
    got = {(r["id"], r["t"]) for r in G.nearest_join(a, b, ("x", "y"), ("u", "v"), ["t"], 2.0).collect()}
    assert got == {("p", 1), ("p", 2), ("q", None), ("n", None)}


def test_nearest_mean(spark):
    sites = spark.createDataFrame([("a", 0.0, 0.0), ("b", 10.0, 0.0), ("c", 99.0, 99.0)], "s string, x double, y double")
    tiles = spark.createDataFrame([(1.0, 0.0, 2.0), (1.0, 0.0, 4.0), (5.0, 0.0, 30.0), (9.0, 1.0, 8.0)], "x double, y double, f double")
    got = {r["s"]: r["f"] for r in G.nearest_mean(sites, "s", ("x", "y"), tiles, ("x", "y"), ["f"]).collect()}
    assert got == {"a": 12.0, "b": 19.0, "c": None}  # the tile in the middle counts for both


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_points_in_polygons(spark):
    shapes = [
        ("big", [square(0, 0, 64, 64), square(20, 20, 40, 40)]),  # with a hole
        ("small", [square(1, 1, 2, 2)]),
        ("notch", [[(-10, 0), (-2, 0), (-2, 8), (-6, 2), (-10, 8)]]),  # concave
    ]
    rings = "array<array<struct<x:double,y:double>>>"
    polys = spark.createDataFrame(
        [(n, [[(float(x), float(y)) for x, y in ring] for ring in r]) for n, r in shapes], f"name string, rings {rings}"
    )
    pts = {
        "in both": (1.5, 1.5), "big only": (50.0, 10.0), "hole": (30.0, 30.0), "edge": (0.0, 5.0), "corner": (64.0, 64.0),
        "small edge": (2.0, 1.5), "notch gap": (-6.0, 5.0), "notch in": (-9.0, 5.0), "outside": (500.0, 500.0), "hole edge": (20.0, 30.0),
    }
    df = spark.createDataFrame([(k, *v) for k, v in pts.items()] + [("null", None, 1.0)], "id string, x double, y double")
    got = {}
    for r in G.points_in_polygons(df, ("x", "y"), polys, "rings", ["name"], "left", "id").collect():
        got.setdefault(r["id"], set()).add(r["name"])
    assert got == {
        "in both": {"big", "small"}, "big only": {"big"}, "hole": {None}, "edge": {None}, "corner": {None},
        "small edge": {"big"}, "notch gap": {None}, "notch in": {"notch"}, "outside": {None}, "hole edge": {None}, "null": {None},
    }
    inner = G.points_in_polygons(df, ("x", "y"), polys, "rings", ["name"])
    assert inner.count() == 5


def test_crowded_cells_are_divided_and_only_borders_tested(spark, monkeypatch):
    rng = random.Random(8)
    star = [(50 + r * math.cos(a), 50 + r * math.sin(a)) for k in range(40) for a, r in [(k * math.pi / 20, 40 if k % 2 else 25)]]
    shapes = [("star", [star]), ("frame", [square(0, 0, 100, 100), square(30, 30, 60.5, 70.25)]), ("bit", [square(49, 49, 51, 51)])]
    polys = spark.createDataFrame([(n, [[(float(x), float(y)) for x, y in ring] for ring in r]) for n, r in shapes], "name string, rings array<array<struct<x:double,y:double>>>")
    pts = [(rng.uniform(-5, 105), rng.uniform(-5, 105)) for _ in range(1500)] + [(rng.uniform(48, 52), rng.uniform(48, 52)) for _ in range(1500)]
    pts += [(float(x), float(y)) for x in (0, 25, 30, 49, 50, 51, 60.5, 100) for y in (0, 30, 49, 50, 51, 70.25, 100)] + [(50.0, 50.0)] * 300
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, x double, y double")

    def found():
        rows = G.points_in_polygons(df, ("x", "y"), polys, "rings", ["name"]).collect()
        assert len(rows) == len({(r["id"], r["name"]) for r in rows})
        return {(r["id"], r["name"]) for r in rows}

    edges = {n: [(a, b) for ring in r for a, b in zip(ring, ring[1:] + ring[:1])] for n, r in shapes}

    def inside(p, n):
        (x, y), odd = p, False
        for (x1, y1), (x2, y2) in edges[n]:
            side = (x - x1) * (y2 - y1) - (x2 - x1) * (y - y1)
            if side == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and (side < 0) == (y2 > y1):
                odd = not odd
        return odd

    want = {(i, n) for i, p in enumerate(pts) for n in edges if inside(p, n)}
    assert found() == want
    monkeypatch.setattr(skew, "CROWD", 20)
    assert found() == want
    cells = G.polygon_cells(polys, "rings", ["name"]).collect()
    whole = [r for r in cells if r["__edges"] is None]
    assert len(whole) > 20 and all(r["name"] != "frame" or len(r["__edges"] or []) < 8 for r in cells)


def test_zonal_mean_and_families(spark):
    rings = "array<array<struct<x:double,y:double>>>"
    polys = spark.createDataFrame([("p", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]), ("q", [[(9.0, 9.0), (10.0, 9.0), (9.5, 10.0)]])], f"name string, r {rings}")
    tiles = spark.createDataFrame([(1.0, 1.0, 2.0), (3.0, 3.0, 4.0), (7.0, 7.0, 9.0)], "x double, y double, f_1 double")
    sites = spark.createDataFrame([("s", 2.0, 2.0), ("t", 9.5, 9.5), ("u", 20.0, 20.0)], "site string, x double, y double")
    out = G.zonal_mean_at_sites(polys, "name", "r", tiles, ("x", "y"), ["f_1"], sites, "site", ("x", "y"))
    assert {r["site"]: r["f_1"] for r in out.collect()} == {"s": 3.0, "t": None}
    wide = G.combine_site_features({"zone": out.drop("name"), "near": sites.select("site", F.col("x").alias("f_1"))}, "site", "f_")
    assert wide.columns == ["site", "zone_f_1", "near_f_1"] and wide.count() == 3
    hh = spark.createDataFrame([(1, "s"), (2, "s"), (3, "none")], "hh int, site string")
    assert {r["hh"]: r["zone_f_1"] for r in G.features_by_household(hh, "hh", "site", wide).collect()} == {1: 3.0, 2: 3.0, 3: None}


# ---------------------------------------------------------------- sources and sinks


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_indicator_csv_with_preamble(spark, tmp_path):
    p = write(tmp_path / "a.csv", '"Data Source","Indicators",\n\n"Last Updated","2025-07-01",\n\n"Country Name","Country Code","Indicator","1960","1961",\n"Côte, X","CIV","pop","1","",\n"World","WLD","pop","..","7.5",\n"Union","EU","pop","2","3",\n')
    df = I.read_indicator_csv(spark, p)
    assert df.columns == ["Country Name", "Country Code", "Indicator", "1960", "1961"]
    assert {tuple(r) for r in df.collect()} == {("Côte, X", "CIV", "pop", 1.0, None), ("World", "WLD", "pop", None, 7.5), ("Union", "EU", "pop", 2.0, 3.0)}
    assert I.year_columns(df) == ["1960", "1961"]


def test_year_headers_and_pruned_csv(spark, tmp_path):
    p = write(tmp_path / "b.csv", 'Country,"Share, of all",2021 [YR2021]\nA,12%,1.5\nB,3%,..\n')
    df = I.plain_year_headers(I.read_csv(spark, p))
    assert [r["2021"] for r in df.collect()] == [1.5, None]
    few = I.read_csv_columns(spark, p, ["Country", "Share, of all"], ["country", "share"])
    assert few.columns == ["country", "share"] and few.count() == 2
    scan = few.select("share")._jdf.queryExecution().executedPlan().toString()
    assert "YR2021" not in scan.split("ReadSchema")[1]


def test_newest_file(spark, tmp_path):
    for day in ("20250101", "20250903", "20240101"):
        write(tmp_path / "aux" / f"aux_data_{day}.csv", "a\n1\n")
    assert I.newest_file(spark, str(tmp_path / "aux" / "aux_data_*.csv")).endswith("aux_data_20250903.csv")
    write(tmp_path / "aux" / "undated.csv", "a\n1\n")
    with pytest.raises(FileNotFoundError):
        I.newest_file(spark, str(tmp_path / "aux" / "undated*.csv"))


def test_dated_sink_is_found_again(spark, tmp_path):
    import datetime as dt

    df = spark.createDataFrame([(1, "x")], "a int, b string")
    O.write_csv_dated(df, str(tmp_path), "table", dt.date(2025, 1, 2))
    path = O.write_csv_dated(df.withColumn("a", F.lit(2)), str(tmp_path), "table", dt.date(2025, 3, 4))
    found = I.newest_file(spark, f"{tmp_path}/table_*.csv/*.csv")
    assert found.endswith("table_20250304.csv") and path.endswith("table_20250304.csv")
    assert I.read_csv(spark, found, "a int, b string").first()["a"] == 2


def test_entities_from_folders(spark, tmp_path):
    row = spark.createDataFrame([(1.0, 2.0)], "y double, w double")
    row.coalesce(1).write.parquet(f"{tmp_path}/tgo/cleaned/train.parquet")
    row.coalesce(1).write.parquet(f"{tmp_path}/tgo/cleaned/test.parquet")
    row.coalesce(1).write.parquet(f"{tmp_path}/ben/clean/train.parquet")
    row.withColumn("extra", F.lit(1)).coalesce(1).write.parquet(f"{tmp_path}/ben/cleaned/train.parquet")
    os.makedirs(f"{tmp_path}/bad/cleaned")
    write(tmp_path / "bad" / "cleaned" / "train.parquet", "not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        I.read_entities(spark, str(tmp_path), columns=["y", "w"]).collect()
    df = I.read_entities(spark, str(tmp_path), columns=["y", "w"], skip_unreadable=True)
    assert sorted((r["entity"], r["part"]) for r in df.collect()) == [("ben", "train"), ("tgo", "test"), ("tgo", "train")]
    gaps = I.entity_gaps(I.entity_files(spark, str(tmp_path)), df)
    assert sorted(map(tuple, gaps.collect())) == [("bad", "test", "no file"), ("bad", "train", "no rows"), ("ben", "test", "no file")]


def test_tagged_and_blank_row(spark, tmp_path):
    write(tmp_path / "d" / "Mzuzu City.csv", "covariate\na\nb\n")
    write(tmp_path / "d" / "Dedza.csv", "covariate\na\n")
    df = I.read_tagged(spark, str(tmp_path / "d"), "covariate string", "district")
    assert sorted(map(tuple, df.collect())) == [("a", "Dedza"), ("a", "Mzuzu City"), ("b", "Mzuzu City")]
    p = write(tmp_path / "e.csv", "Economy,Code\nBenin,BEN\nGhana,GHA\n,\nAfrica,AFR\n,\n")
    assert [r["Code"] for r in I.above_first_blank_row(spark, p, "Economy string, Code string").collect()] == ["BEN", "GHA"]
    q = write(tmp_path / "f.csv", "Economy,Code\nBenin,BEN\n")
    assert I.above_first_blank_row(spark, q, "Economy string, Code string").count() == 1


def test_join_by_position(spark, tmp_path):
    rows = spark.range(2000).repartitionByRange(5, "id").sortWithinPartitions("id")
    rows.write.option("header", True).csv(f"{tmp_path}/ids")
    spark.range(2000).coalesce(1).selectExpr("id * 3 AS v").write.option("header", True).csv(f"{tmp_path}/values")
    left, right = I.read_with_position(spark, f"{tmp_path}/ids", "id long"), I.read_with_position(spark, f"{tmp_path}/values", "v long")
    got = I.join_by_position(left, right)
    assert got.count() == 2000 and got.filter("v != id * 3 OR position != id").isEmpty()
    with pytest.raises(ValueError, match="2000 rows"):
        I.join_by_position(left, right.filter("v > 0"))


def test_results_grow_with_new_columns(spark, tmp_path):
    path = f"{tmp_path}/results"
    O.append_result(spark.createDataFrame([(1.0,)], "cost double"), path, policy_type="ubi")
    O.append_result(spark.createDataFrame([(2.0, 3)], "cost double, d int"), path, policy_type="gap", features="all")
    got = {(r["policy_type"], r["cost"], r["d"], r["features"]) for r in I.read_results(spark, path).collect()}
    assert got == {("ubi", 1.0, None, None), ("gap", 2.0, 3, "all")}
    O.rewrite_without(I.read_results(spark, path), F.col("d") == 3, f"{tmp_path}/kept")
    assert I.read_results(spark, f"{tmp_path}/kept").count() == 1
    O.write_parquet(spark.createDataFrame([(1, "a")], "x int, p string"), f"{tmp_path}/part", ["p"])
    assert I.read_parquet(spark, f"{tmp_path}/part", ["x"]).first()["x"] == 1


def test_key_value(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    assert dict(map(tuple, O.key_value(df, {"total": F.sum("v"), "top": F.max("v")}).collect())) == {"total": 4.0, "top": 3.0}
