"""Spatial joins in plane coordinates.

Nearest neighbours: the right-hand locations are put into a quadtree of occupied
cells, and each left-hand location walks down it, keeping only cells that can
still hold its nearest neighbour. The candidates of a location stay few whatever
the density, so a crowded cell never meets all its points with each other. A tree
of counted size is broadcast; otherwise cells crowded with left-hand locations are
cut into pieces that each get the cell's few right-hand rows.

Points in polygons: every polygon is filed under the few grid cells of its own
size class, as a cell inside of it, which needs no more tests, or as one on its
border. Points look up one cell per size class and count edge crossings at borders
only. Cells crowded with points are divided and classified anew.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import MapType

from welfarelens.operators import skew
from welfarelens.session import written_once

MAX_LEVEL = 26
BROADCAST_LEVEL = 8  # 4 ** 8 cells at most
#: Right-hand locations, of four numbers each, that are broadcast; they are counted first.
BROADCAST_LOCATIONS = 1 << 16


# ---------------------------------------------------------------- nearest


def _square(a: Column) -> Column:
    return a * a


def _gap(p: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo - p, p - hi, F.lit(0.0))


def _cell(c: Column, origin: float, size: float, level: int) -> Column:
    """The cell of a coordinate; what lies outside of the box belongs to the cell at its border."""
    n = 1 << level
    inside = F.greatest(F.least((c - F.lit(origin)) / F.lit(size), F.lit(1.0)), F.lit(0.0))
    return F.least(F.floor(inside * F.lit(float(n))).cast("long"), F.lit(n - 1))


def nearest_locations(
    left: DataFrame, right: DataFrame, max_distance: float | None = None, leaf: int = 64
) -> DataFrame:
    """Nearest different right location of every different left location, all ties kept.

    Both inputs have the columns x and y. Rows: lx, ly, rx, ry, distance. Without
    ``max_distance`` every left location gets a neighbour. NULL and NaN coordinates
    take no part; infinite ones are an error.
    """
    sites = left.select(F.col("x").cast("double").alias("lx"), F.col("y").cast("double").alias("ly")).dropna().distinct()
    tiles = right.select(F.col("x").cast("double").alias("rx"), F.col("y").cast("double").alias("ry")).dropna().distinct()
    box = tiles.agg(
        F.min("rx").alias("x0"), F.max("rx").alias("x1"), F.min("ry").alias("y0"), F.max("ry").alias("y1"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if box["n"] == 0:
        return sites.select(
            "lx", "ly", *[F.lit(None).cast("double").alias(c) for c in ("rx", "ry", "distance")]
        ).limit(0)
    size = max(box["x1"] - box["x0"], box["y1"] - box["y0"]) or 1.0
    if not math.isfinite(size):
        raise ValueError("coordinates must be finite")
    small = box["n"] <= BROADCAST_LOCATIONS

    def cells_at(level: int) -> list[Column]:
        return [
            _cell(F.col("rx"), box["x0"], size, level).alias("cx"),
            _cell(F.col("ry"), box["y0"], size, level).alias("cy"),
        ]

    # deep enough that no cell holds more than ``leaf`` locations
    depth = max(0, math.ceil(math.log(max(1.0, box["n"] / leaf), 4)))
    while depth < MAX_LEVEL and box["n"] > leaf:
        fullest = tiles.groupBy(*cells_at(depth)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if fullest <= leaf:
            break
        depth = min(MAX_LEVEL, depth + max(1, math.ceil(math.log(fullest / leaf, 4) / 2)))

    placed = tiles.select("rx", "ry", *cells_at(depth))
    # the box of a cell's locations, and one of them: (x0, yr)
    boxes = placed.groupBy("cx", "cy").agg(
        F.min("rx").alias("x0"), F.max("rx").alias("x1"), F.min("ry").alias("y0"), F.max("ry").alias("y1"),
        F.min_by("ry", "rx").alias("yr"),
    )

    def level_boxes(level: int, parent: int) -> DataFrame:
        """Occupied cells of a level with the box of their locations and their cell at ``parent``."""
        up = depth - level
        cells = (
            boxes.select(
                F.shiftright("cx", up).alias("cx"), F.shiftright("cy", up).alias("cy"), "x0", "x1", "y0", "y1", "yr"
            )
            .groupBy("cx", "cy")
            .agg(
                F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
                F.min_by("yr", "x0").alias("yr"),
            )
        )
        return cells.select(
            F.shiftright("cx", level - parent).alias("px"), F.shiftright("cy", level - parent).alias("py"),
            "cx", "cy", "x0", "x1", "y0", "y1", "yr",
        )

    per_site = W.partitionBy("lx", "ly")
    limit = math.inf if max_distance is None else float(max_distance) ** 2 * (1 + 1e-9)
    d2 = _square(F.col("lx") - F.col("rx")) + _square(F.col("ly") - F.col("ry"))

    # a first bound from the locations in the site's own deepest cell, if there are any
    own = sites.select(
        "lx", "ly", _cell(F.col("lx"), box["x0"], size, depth).alias("qx"),
        _cell(F.col("ly"), box["y0"], size, depth).alias("qy"),
    )

    def with_locations(rows: DataFrame) -> DataFrame:
        """Rows with the locations of their deepest cell (qx, qy)."""
        if small:
            return skew.matched(rows, F.broadcast(placed), ["qx", "qy"], ["cx", "cy"])
        return skew.split_join(rows, placed, ["qx", "qy"], ["cx", "cy"], ["lx", "ly"])

    first = with_locations(own).select("lx", "ly", d2.alias("d2"))
    first = first.unionByName(sites.select("lx", "ly", F.lit(limit).alias("d2")))
    bounded = first.groupBy("lx", "ly").agg(F.min("d2").alias("bound"))

    def keep_possible(rows: DataFrame) -> DataFrame:
        """Cells not farther than the nearest location known so far. Ties are kept."""
        near = _square(_gap(F.col("lx"), F.col("x0"), F.col("x1"))) + _square(_gap(F.col("ly"), F.col("y0"), F.col("y1")))
        known = _square(F.col("lx") - F.col("x0")) + _square(F.col("ly") - F.col("yr"))
        rows = rows.select("lx", "ly", "bound", "cx", "cy", near.alias("near"), known.alias("known"))
        return (
            rows.filter(F.col("near") <= F.col("bound"))
            .withColumn("bound", F.least("bound", F.min("known").over(per_site)))
            .filter(F.col("near") <= F.col("bound"))
            .select("lx", "ly", "bound", "cx", "cy")
        )

    level = min(2, depth)
    top = level_boxes(level, 0).drop("px", "py").collect()  # at most 16 cells
    cells = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in r.asDict().items()]) for r in top])
    found = keep_possible(bounded.select("lx", "ly", "bound", F.inline(cells)))
    while level < depth:
        step = min(level + 2, depth)
        children = level_boxes(step, level)
        parents = found.select("lx", "ly", "bound", F.col("cx").alias("qx"), F.col("cy").alias("qy"))
        if small or step <= BROADCAST_LEVEL:
            met = skew.matched(parents, F.broadcast(children), ["qx", "qy"], ["px", "py"])
        else:  # a parent has at most 16 children
            met = skew.split_join(written_once(parents), children, ["qx", "qy"], ["px", "py"], ["lx", "ly"])
        found = keep_possible(met)
        level = step
    leaves = found.select("lx", "ly", F.col("cx").alias("qx"), F.col("cy").alias("qy"))
    pairs = with_locations(leaves if small else written_once(leaves)).select("lx", "ly", "rx", "ry", d2.alias("d2"))
    nearest = pairs.withColumn("best", F.min("d2").over(per_site)).filter(F.col("d2") == F.col("best"))
    nearest = nearest.select("lx", "ly", "rx", "ry", F.sqrt("d2").alias("distance"))
    return nearest if max_distance is None else nearest.filter(F.col("distance") <= float(max_distance))


def _with_xy(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.withColumns({"__x": F.col(x).cast("double"), "__y": F.col(y).cast("double")})


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    left_xy: tuple[str, str],
    right_xy: tuple[str, str],
    right_columns: Sequence[str],
    max_distance: float | None = None,
    how: str = "left",
    leaf: int = 64,
) -> DataFrame:
    """Left rows with the columns of their nearest right row(s) and ``distance``; ties give several rows."""
    pairs = nearest_locations(
        left.select(F.col(left_xy[0]).alias("x"), F.col(left_xy[1]).alias("y")),
        right.select(F.col(right_xy[0]).alias("x"), F.col(right_xy[1]).alias("y")),
        max_distance, leaf,
    )
    a = _with_xy(left, *left_xy)
    b = right.select(
        F.col(right_xy[0]).cast("double").alias("__rx"), F.col(right_xy[1]).cast("double").alias("__ry"), *right_columns
    )
    found = pairs.join(b, (F.col("rx") == F.col("__rx")) & (F.col("ry") == F.col("__ry"))).drop(
        "__rx", "__ry", "rx", "ry"
    )
    return a.join(found, (F.col("__x") == F.col("lx")) & (F.col("__y") == F.col("ly")), how).drop(
        "__x", "__y", "lx", "ly"
    )


def nearest_mean(
    sites: DataFrame,
    site: str,
    site_xy: tuple[str, str],
    tiles: DataFrame,
    tile_xy: tuple[str, str],
    features: Sequence[str],
    leaf: int = 64,
) -> DataFrame:
    """Mean features of the tiles that are nearer to a site than to any other (NULL if it has none).

    Tiles are summed per location before they meet the sites; a tile at equal
    distance from several sites counts for each.
    """
    pairs = nearest_locations(
        tiles.select(F.col(tile_xy[0]).alias("x"), F.col(tile_xy[1]).alias("y")),
        sites.select(F.col(site_xy[0]).alias("x"), F.col(site_xy[1]).alias("y")),
        None, leaf,
    )
    local = _with_xy(tiles, *tile_xy).groupBy("__x", "__y").agg(
        *[F.sum(c).alias(f"__s_{c}") for c in features], *[F.count(c).alias(f"__n_{c}") for c in features]
    )
    at_site = (
        local.join(pairs, (F.col("__x") == F.col("lx")) & (F.col("__y") == F.col("ly")))
        .groupBy("rx", "ry")
        .agg(*[F.try_divide(F.sum(f"__s_{c}"), F.sum(f"__n_{c}")).alias(c) for c in features])
    )
    return (
        _with_xy(sites.select(site, *site_xy), *site_xy)
        .join(at_site, (F.col("__x") == F.col("rx")) & (F.col("__y") == F.col("ry")), "left")
        .select(site, *features)
    )


# ---------------------------------------------------------------- points in polygons


def polygon_edges(rings: str) -> Column:
    """Edges of a polygon given as an array of rings of (x, y), outer ring and holes alike."""

    def ring_edges(ring: Column) -> Column:
        n = F.size(ring)
        return F.transform(
            F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n),
            lambda i: F.struct(
                F.get(ring, i)["x"].alias("x1"), F.get(ring, i)["y"].alias("y1"),
                F.get(ring, (i + 1) % n)["x"].alias("x2"), F.get(ring, (i + 1) % n)["y"].alias("y2"),
            ),
        )

    return F.flatten(F.transform(F.col(rings), ring_edges))


def strictly_inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd test against an array of edges; points on an edge are outside."""

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        left = (x - e["x1"]) * (e["y2"] - e["y1"]) < (e["x2"] - e["x1"]) * (y - e["y1"])
        return spans & (left == (e["y2"] > e["y1"]))

    def touches(e: Column) -> Column:
        on_line = (x - e["x1"]) * (e["y2"] - e["y1"]) == (e["x2"] - e["x1"]) * (y - e["y1"])
        return (
            on_line
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    return (F.size(F.filter(edges, crosses)) % 2 == 1) & ~F.exists(edges, touches)


def _reaches(e: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Whether an edge comes into a box, or within a billionth of its side."""
    slack = (x1 - x0) * 1e-9
    left, right, low, high = x0 - slack, x1 + slack, y0 - slack, y1 + slack
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    sides = [(x - e["x1"]) * dy - (y - e["y1"]) * dx for x in (left, right) for y in (low, high)]
    return (
        (F.greatest(e["x1"], e["x2"]) >= left) & (F.least(e["x1"], e["x2"]) <= right)
        & (F.greatest(e["y1"], e["y2"]) >= low) & (F.least(e["y1"], e["y2"]) <= high)
        & (F.greatest(*sides) >= 0) & (F.least(*sides) <= 0)
    )


def _classified(cells: DataFrame, side: Column, row_edges: Column) -> DataFrame:
    """Cells (``__ix``, ``__iy``, in units of ``side``) of a polygon that are not outside of it.

    ``__edges`` becomes NULL for a cell inside; a cell on the border keeps ``row_edges``, those that reach into its row.
    """
    x0, y0 = F.col("__ix") * side, F.col("__iy") * side
    cells = cells.withColumn("__edges", row_edges)
    border = F.exists("__edges", lambda e: _reaches(e, x0, x0 + side, y0, y0 + side))
    cells = cells.withColumn("__border", border)
    inside = strictly_inside(x0 + side / 2, y0 + side / 2, F.col("__edges"))
    cells = cells.filter(F.col("__border") | inside)
    return cells.withColumn("__edges", F.when(F.col("__border"), F.col("__edges"))).drop("__border")


def _in_row(low: Column, high: Column) -> Column:
    return F.filter("__edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= low) & (F.least(e["y1"], e["y2"]) <= high))


def _shapes(polygons: DataFrame, rings: str, polygon_columns: Sequence[str]) -> DataFrame:
    """Polygons with their edges, the box around them and their size class.

    The grid of a class has a side of an eighth of the next power of two above the polygon's side.
    """
    shapes = polygons.select(*polygon_columns, polygon_edges(rings).alias("__edges")).filter(F.size("__edges") > 0)
    xs, ys = F.transform("__edges", lambda e: e["x1"]), F.transform("__edges", lambda e: e["y1"])
    shapes = shapes.withColumns(
        {"__x0": F.array_min(xs), "__x1": F.array_max(xs), "__y0": F.array_min(ys), "__y1": F.array_max(ys)}
    )
    longest = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"), F.lit(1e-12))
    return shapes.withColumn("__class", F.ceil(F.log2(longest)).cast("int") - 3)


def polygon_cells(polygons: DataFrame, rings: str, polygon_columns: Sequence[str]) -> DataFrame:
    """The cells of every polygon in the grid of its size class, at most 10 x 10: ``__class``, ``__ix``, ``__iy``
    and ``__edges``.

    ``__edges`` are what a point in the cell must be tested against, NULL if the whole cell is inside.
    """
    shapes = _shapes(polygons, rings, polygon_columns)
    side = F.pow(F.lit(2.0), F.col("__class"))

    def span(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / side).cast("long"), F.floor(F.col(hi) / side).cast("long")))

    rows = shapes.withColumn("__iy", span("__y0", "__y1"))
    rows = rows.withColumn("__edges", _in_row(F.col("__iy") * side, (F.col("__iy") + 1) * side))
    cells = rows.withColumn("__ix", span("__x0", "__x1"))
    return _classified(cells, side, F.col("__edges")).select(*polygon_columns, "__class", "__ix", "__iy", "__edges")


def points_in_polygons(
    points: DataFrame,
    xy: tuple[str, str],
    polygons: DataFrame,
    rings: str,
    polygon_columns: Sequence[str],
    how: str = "inner",
    point_id: str | None = None,
) -> DataFrame:
    """Points with the columns of the polygon(s) they lie strictly inside of.

    ``how='left'`` keeps points outside all polygons and needs a unique
    ``point_id``. Points without a coordinate lie in no polygon.
    """
    cover = polygon_cells(polygons, rings, polygon_columns)
    classes = sorted(r[0] for r in _shapes(polygons, rings, []).select("__class").distinct().collect())
    x, y = F.col(xy[0]).cast("double"), F.col(xy[1]).cast("double")
    side = F.pow(F.lit(2.0), F.col("__class"))
    keys = ["__class", "__ix", "__iy"]
    keyed = (
        points.filter(x.isNotNull() & y.isNotNull())
        .withColumn("__class", F.explode(F.array(*[F.lit(c) for c in classes]) if classes else F.array().cast("array<int>")))
        .withColumns({"__ix": F.floor(x / side).cast("long"), "__iy": F.floor(y / side).cast("long")})
    )
    # a point meets each of the polygons in its cell
    crowded = skew.crowded_keys(keyed, keys)
    if crowded is not None:
        parts = F.pow(
            F.lit(2), F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(F.log(4.0, F.col("__rows") / skew.CROWD))))
        ).cast("long")
        crowded = F.broadcast(crowded.select(*keys, parts.alias("__parts")))
        fine = side / F.col("__parts")
        keyed = skew.matched(keyed, crowded, keys, keys, "left").withColumns(
            {"__ix": F.coalesce(F.floor(x / fine).cast("long"), "__ix"), "__iy": F.coalesce(F.floor(y / fine).cast("long"), "__iy")}
        )
        cover = skew.matched(cover, crowded, keys, keys, "left")
        whole = cover.filter("__parts is null").withColumn("__parts", F.lit(None).cast("long"))
        steps = F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)
        split = cover.filter("__parts is not null")
        split = split.withColumn("__step", F.explode(steps)).withColumn("__iy", F.col("__iy") * F.col("__parts") + F.col("__step"))
        split = split.withColumn("__step", F.explode(steps)).withColumn("__ix", F.col("__ix") * F.col("__parts") + F.col("__step"))
        inside = split.filter("__edges is null")
        border = _classified(
            split.filter("__edges is not null"), fine, _in_row(F.col("__iy") * fine, (F.col("__iy") + 1) * fine)
        )
        cover = whole.unionByName(inside.unionByName(border).drop("__step"))
        keyed = keyed.withColumn("__parts", F.coalesce("__parts", F.lit(1).cast("long")))
        cover = cover.withColumn("__parts", F.coalesce("__parts", F.lit(1).cast("long")))
        keys = [*keys, "__parts"]
        spread = [c for c in points.columns if not isinstance(points.schema[c].dataType, MapType)]
        met = skew.split_join(keyed, cover, keys, keys, spread)
    else:
        met = skew.matched(keyed, cover, keys, keys)
    hits = met.filter(F.col("__edges").isNull() | strictly_inside(x, y, F.col("__edges"))).select(
        *points.columns, *polygon_columns
    )
    if how == "inner":
        return hits
    if point_id is None:
        raise ValueError("a left join needs point_id")
    side_table = hits.select(F.col(point_id).alias("__pid"), *polygon_columns)
    return points.join(side_table, F.col(point_id) == F.col("__pid"), "left").drop("__pid")


def zonal_mean(
    polygons: DataFrame,
    polygon: str,
    rings: str,
    tiles: DataFrame,
    tile_xy: tuple[str, str],
    features: Sequence[str],
) -> DataFrame:
    """Mean features of the tiles inside each polygon (NULL for a polygon without tiles)."""
    inside = points_in_polygons(tiles.select(*tile_xy, *features), tile_xy, polygons, rings, [polygon])
    means = inside.groupBy(polygon).agg(*[F.avg(c).alias(c) for c in features])
    return polygons.select(polygon, rings).join(means, polygon, "left")


def zonal_mean_at_sites(
    polygons: DataFrame,
    polygon: str,
    rings: str,
    tiles: DataFrame,
    tile_xy: tuple[str, str],
    features: Sequence[str],
    sites: DataFrame,
    site: str,
    site_xy: tuple[str, str],
) -> DataFrame:
    """Each site inside a polygon with the polygon's tile means."""
    means = zonal_mean(polygons, polygon, rings, tiles, tile_xy, features).drop(rings)
    placed = points_in_polygons(sites.select(site, *site_xy), site_xy, polygons, rings, [polygon])
    return placed.select(site, polygon).join(means, polygon, "left").select(site, polygon, *features)


def combine_site_features(families: dict[str, DataFrame], site: str, stem: str) -> DataFrame:
    """Outer join of feature families by site, each family's columns prefixed with its name."""
    out = None
    for name, table in families.items():
        renamed = table.withColumnsRenamed(
            {c: f"{name}_{c}" for c in table.columns if c.startswith(stem)}
        )
        out = renamed if out is None else out.join(renamed, site, "full")
    return out


def features_by_household(households: DataFrame, household: str, site: str, features: DataFrame) -> DataFrame:
    """Fan the site features out to the households of the site."""
    return households.select(household, site).join(features, site, "left").drop(site)
