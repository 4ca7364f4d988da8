"""Spatial joins on the first numbers of the embeddings, taken as coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from welfarelens.operators import spatial as G
from workloads.registry import query
from workloads.tables import POINTS, SITES, points, rounded, sites_and_tiles, with_

FEATURES = ["feature_0", "feature_1"]


@query(with_(POINTS, SITES) + """, d AS (SELECT site, tile, feature_0,
  sqrt((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y)) AS distance FROM sites s, tiles t),
m AS (SELECT site, min(distance) AS best FROM d GROUP BY site)
SELECT s.site, d.tile, round(d.distance, 6) AS distance, round(d.feature_0, 6) AS feature_0
FROM sites s LEFT JOIN (SELECT d.* FROM d JOIN m ON d.site = m.site AND distance = best AND distance <= 0.02) d ON s.site = d.site""")
def nearest_within(spark, sf):
    sites, tiles = sites_and_tiles(spark, sf)
    tiles = tiles.select("tile", "feature_0", F.col("x").alias("tx"), F.col("y").alias("ty"))
    out = G.nearest_join(sites, tiles, ("x", "y"), ("tx", "ty"), ["tile", "feature_0"], 0.02)
    return rounded(out.select("site", "tile", "distance", "feature_0"), "distance", "feature_0")


@query(with_(POINTS, SITES) + """, d AS (SELECT site, tile, feature_0, feature_1,
  sqrt((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y)) AS distance FROM sites s, tiles t),
m AS (SELECT tile, min(distance) AS best FROM d GROUP BY tile)
SELECT s.site, round(avg(d.feature_0), 6) AS feature_0, round(avg(d.feature_1), 6) AS feature_1
FROM sites s LEFT JOIN (SELECT d.* FROM d JOIN m ON d.tile = m.tile AND distance = best) d ON s.site = d.site GROUP BY s.site""")
def nearest_mean(spark, sf):
    sites, tiles = sites_and_tiles(spark, sf)
    return rounded(G.nearest_mean(sites, "site", ("x", "y"), tiles, ("x", "y"), FEATURES), *FEATURES)


def areas(spark, sf):
    """One L-shaped area per label, spanned by its sites."""
    ends = points(spark, sf).groupBy("label").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    xm, ym = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2

    def at(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    ring = F.array(at(x0, y0), at(x1, y0), at(x1, ym), at(xm, ym), at(xm, y1), at(x0, y1))
    return ends.select(F.col("label").alias("area"), F.array(ring).alias("rings"))


_AREAS = """ends AS (SELECT label AS area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points GROUP BY label),
inside AS (SELECT vec_id, area FROM points p, ends
  WHERE x > x0 AND y > y0 AND ((x < x1 AND y < (y0 + y1) / 2) OR (x < (x0 + x1) / 2 AND y < y1))),
tiles_inside AS (SELECT area, feature_0, feature_1 FROM tiles p, ends
  WHERE x > x0 AND y > y0 AND ((x < x1 AND y < (y0 + y1) / 2) OR (x < (x0 + x1) / 2 AND y < y1)))"""


@query(with_(POINTS, SITES, _AREAS) + "SELECT p.vec_id, area FROM points p LEFT JOIN inside i ON p.vec_id = i.vec_id")
def points_in_polygons(spark, sf):
    out = G.points_in_polygons(
        points(spark, sf), ("x", "y"), areas(spark, sf), "rings", ["area"], how="left", point_id="vec_id"
    )
    return out.select("vec_id", "area")


@query(with_(POINTS, SITES, _AREAS) + """, z AS (SELECT area, avg(feature_0) AS feature_0, avg(feature_1) AS feature_1 FROM tiles_inside GROUP BY area)
SELECT i.vec_id AS site, i.area, round(z.feature_0, 6) AS feature_0, round(z.feature_1, 6) AS feature_1
FROM inside i LEFT JOIN z ON i.area = z.area""")
def zonal_mean(spark, sf):
    sites, tiles = sites_and_tiles(spark, sf)
    out = G.zonal_mean_at_sites(
        areas(spark, sf), "area", "rings", tiles, ("x", "y"), FEATURES,
        sites, "site", ("x", "y"),
    )
    return rounded(out, *FEATURES)


@query(with_(POINTS) + """, a AS (SELECT label AS site, avg(feature_0) AS feature_0 FROM points WHERE label < 7 GROUP BY 1),
b AS (SELECT label AS site, max(feature_1) AS feature_1 FROM points WHERE label > 3 GROUP BY 1),
f AS (SELECT coalesce(a.site, b.site) AS site, feature_0 AS mean_feature_0, feature_1 AS top_feature_1 FROM a FULL JOIN b ON a.site = b.site)
SELECT vec_id, round(mean_feature_0, 6) AS mean_feature_0, round(top_feature_1, 6) AS top_feature_1 FROM points LEFT JOIN f ON label = site""")
def site_features_by_household(spark, sf):
    p = points(spark, sf).withColumnRenamed("label", "site")
    families = {
        "mean": p.filter("site < 7").groupBy("site").agg(F.avg("feature_0").alias("feature_0")),
        "top": p.filter("site > 3").groupBy("site").agg(F.max("feature_1").alias("feature_1")),
    }
    features = G.combine_site_features(families, "site", "feature_")
    out = G.features_by_household(p, "vec_id", "site", features)
    return rounded(out, "mean_feature_0", "top_feature_1")
