"""Reproducible splits and folds.

Rows are ordered by a hash of their id and a seed. To cut that order at given
ranks, rows are counted per hash range, the range that holds each rank is found
from the counts, and only that range is sorted. The table itself is neither
sorted nor shuffled, and a stratum that holds most rows is spread over all hash
ranges. It is read three times: for the counts, which also give all sizes and
quotas, for the ranges that hold a cut, and to mark its rows. Ids must be unique:
rows with the same id land on the same side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from welfarelens.operators.ordered import row_places, running_totals
from welfarelens.session import written_once

HASH_RANGES = 4096
#: Rows of a shuffled table that are sorted together, about.
SHUFFLED_TOGETHER = 1 << 18


def hash_order(id_column: str, seed: int) -> Column:
    """Position of a row in the reproducible random order: 60 bits of the MD5 of ``<seed>:<id>``.

    Other engines have the same hash, so an order can be checked or repeated elsewhere.
    """
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def _hash_range(h: Column) -> Column:
    return F.shiftright(h, 48).cast("int")  # the upper 12 of 60 bits


def hash_counts(df: DataFrame, id_column: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows (``__n``) of every stratum and hash range (``__range``), counted once and written."""
    ranged = df.select(*by, _hash_range(hash_order(id_column, seed)).alias("__range"))
    return written_once(ranged.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n")))


def hash_cuts(
    df: DataFrame, id_column: str, seed: int, counts: DataFrame, ranks: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """The (hash, id) at given 1-based ranks of each stratum.

    ``counts`` come from ``hash_counts``; ``ranks`` has the strata columns, ``cut``
    (a number) and ``rank``. Returns the strata columns, ``cut`` and ``position`` (a
    struct). Ranks below 1 or above the stratum's size have no row.
    """
    by = list(by)
    h = hash_order(id_column, seed)
    keyed = df.select(*by, h.alias("__h"), F.col(id_column).cast("string").alias("__id")).withColumn(
        "__range", _hash_range(F.col("__h"))
    )
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy("__range").rowsBetween(W.unboundedPreceding, 0)
    ends = counts.withColumn("__end", F.sum("__n").over(w)).withColumn("__start", F.col("__end") - F.col("__n"))
    wanted = _equal_join(ends, ranks, by).filter(
        (F.col("rank") > F.col("__start")) & (F.col("rank") <= F.col("__end"))
    ).select(*by, "__range", "cut", (F.col("rank") - F.col("__start")).cast("long").alias("__r"))
    wanted = written_once(wanted)
    # rows of the few ranges that hold a cut; one range is about 1/4096 of a stratum
    inside = _equal_join(keyed, wanted.select(*by, "__range").distinct(), [*by, "__range"])
    order = W.partitionBy(*by, "__range").orderBy("__h", "__id")
    numbered = inside.withColumn("__rn", F.row_number().over(order)).withColumn(
        "position", F.struct(F.col("__h").alias("h"), F.col("__id").alias("id"))
    )
    return _equal_join(
        numbered.select(*by, "__range", F.col("__rn").cast("long").alias("__r"), "position"),
        wanted,
        [*by, "__range", "__r"],
    ).select(*by, "cut", "position")


def _equal_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL equals NULL, keeping the left keys."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, match, how).drop(*[f"__r_{k}" for k in keys])


def stratum_quotas(sizes: DataFrame, fraction: float, by: Sequence[str]) -> DataFrame:
    """Training rows per stratum: shares rounded down, the rest to the largest remainders.

    ``sizes`` has one row per stratum with its ``rows``. The training set has
    round-half-up(fraction * n) rows in all. Strata are ranked by their remainder,
    then by their columns, in ranges, so there may be millions of them.
    """
    by = list(by)
    exact = F.col("rows") * F.lit(float(fraction))
    # 1e-9 keeps 0.6 * 10 from counting as 5.999...
    sizes = sizes.withColumn("base", F.floor(exact + 1e-9).cast("long")).withColumn(
        "rest", F.greatest(exact - F.col("base"), F.lit(0.0))
    )
    placed = row_places(sizes, [F.round("rest", 9).desc(), *[F.col(c).asc_nulls_first() for c in by]])
    extra = placed.agg(
        (F.floor(F.sum("rows") * F.lit(float(fraction)) + 0.5) - F.sum("base")).cast("long").alias("extra")
    ).first()["extra"]
    return placed.select(*by, "rows", (F.col("base") + (F.col("place") <= F.lit(extra or 0)).cast("long")).alias("quota"))


def _here(id_column: str, seed: int) -> Column:
    return F.struct(hash_order(id_column, seed).alias("h"), F.col(id_column).cast("string").alias("id"))


def _rows_in_all(counts: DataFrame) -> int:
    return counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]


def _split_at(df: DataFrame, id_column: str, seed: int, counts: DataFrame, quota: int) -> DataFrame:
    """Add ``split``: the first ``quota`` rows of the random order train."""
    one = df.sparkSession.createDataFrame([(1, quota)], "cut int, rank long")
    cut = hash_cuts(df, id_column, seed, counts, one).first()
    if cut is None:
        first = F.lit(False)
    else:
        at = cut["position"]
        first = _here(id_column, seed) <= F.struct(F.lit(at["h"]).alias("h"), F.lit(at["id"]).alias("id"))
    return df.withColumn("split", F.when(first, F.lit("train")).otherwise(F.lit("test")))


def stratified_split(
    df: DataFrame, id_column: str, fraction: float = 0.6, seed: int = 1234, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``split`` = 'train' or 'test'; every stratum gets its quota exactly.

    Without strata it is a plain random split.
    """
    by = list(by)
    counts = hash_counts(df, id_column, seed, by)
    if not by:
        return _split_at(df, id_column, seed, counts, math.floor(_rows_in_all(counts) * float(fraction) + 0.5))
    quotas = stratum_quotas(counts.groupBy(*by).agg(F.sum("__n").alias("rows")), fraction, by)
    ranks = quotas.select(*by, F.lit(1).alias("cut"), F.col("quota").alias("rank"))
    cuts = hash_cuts(df, id_column, seed, counts, ranks, by).select(*by, F.col("position").alias("__cut"))
    joined = _equal_join(df, cuts, by, "left")
    return joined.withColumn(
        "split", F.when(_here(id_column, seed) <= F.col("__cut"), F.lit("train")).otherwise(F.lit("test"))
    ).drop("__cut")


def random_split(
    df: DataFrame, id_column: str, fraction: float, seed: int = 123456, weight: str | None = None
) -> DataFrame:
    """Add ``split``: the first floor(fraction * n) rows of the random order train.

    Without a weight column each part gets uniform weights 1/n as ``weight``.
    """
    counts = hash_counts(df, id_column, seed)
    rows = _rows_in_all(counts)
    quota = math.floor(rows * float(fraction) + 1e-9)
    out = _split_at(df, id_column, seed, counts, quota)
    if weight is None:
        share = F.when(F.col("split") == "train", F.lit(1.0 / max(quota, 1))).otherwise(F.lit(1.0 / max(rows - quota, 1)))
        out = out.withColumn("weight", share)
    return out


def even_folds(df: DataFrame, id_column: str, folds: int = 10, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Add ``fold`` 0..folds-1 with boundaries round(i n / folds) of the random order.

    With ``by`` every class is cut by itself, which gives stratified folds.
    """
    by = list(by)
    counts = hash_counts(df, id_column, seed, by)
    steps = F.sequence(F.lit(1), F.lit(folds - 1)) if folds > 1 else F.array().cast("array<int>")

    def boundary(i: Column) -> Column:
        # banker's rounding, as the boundaries are defined
        return F.bround(i * F.col("__n") / F.lit(float(folds)), 0).cast("long")

    sizes = counts.groupBy(*by).agg(F.sum("__n").alias("__n"))
    ranks = sizes.select(*by, "__n", F.explode(steps).alias("cut")).select(*by, "cut", boundary(F.col("cut")).alias("rank"))
    cuts = hash_cuts(df, id_column, seed, counts, ranks, by)
    # folds - 1 positions per stratum; ranks below 1 have none, as the folds before them are empty
    lists = cuts.groupBy(*by).agg(F.array_sort(F.collect_list("position")).alias("__cuts"))
    lost = sizes.select(*by, F.size(F.filter(steps, lambda i: boundary(i) < 1)).alias("__lost"))
    joined = _equal_join(df, _equal_join(lost, lists, by, "left"), by, "left").withColumn("__here", _here(id_column, seed))
    passed = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__here"))), F.lit(0))
    return joined.withColumn("fold", (F.col("__lost") + F.greatest(passed, F.lit(0))).cast("int")).drop(
        "__cuts", "__lost", "__here"
    )


def shuffled(df: DataFrame, id_column: str, seed: int = 0, out: str = "place") -> DataFrame:
    """Add each row's place 1..n in a random order that depends on the unique id and the seed only.

    The order is that of ``hash_order``. Rows are counted per range of the hash; a range's first place is the sum of
    the counts before it, and only rows of the same range are sorted together. The first ``k`` places are a random
    sample of ``k`` rows, and sorting by the place reads the order back.
    """
    named = df.withColumn("__h", hash_order(id_column, seed))
    fine = written_once(named.groupBy(F.shiftright("__h", 44).alias("__range")).agg(F.count(F.lit(1)).alias("__n")))
    # fewer bits, so fewer and fuller ranges, for smaller tables
    bits = min(16, max(3, math.ceil(math.log2(max(1.0, _rows_in_all(fine) / SHUFFLED_TOGETHER)))))
    counts = fine.groupBy(F.shiftright("__range", 16 - bits).alias("__range")).agg(F.sum("__n").alias("__n"))
    bases, before = [], 0
    for r in counts.orderBy("__range").collect():  # at most 65,536
        bases.append((r["__range"], before))
        before += r["__n"]
    bases = F.broadcast(df.sparkSession.createDataFrame(bases, "__range long, __base long"))
    inside = W.partitionBy("__range").orderBy("__h", F.col(id_column).cast("string"))
    placed = named.withColumn("__range", F.shiftright("__h", 60 - bits)).withColumn("__in", F.row_number().over(inside))
    return placed.join(bases, "__range").withColumn(out, F.col("__base") + F.col("__in")).drop("__range", "__h", "__in", "__base")


def group_folds(df: DataFrame, group: str, folds: int = 5, share: float = 0.001) -> DataFrame:
    """Add ``fold`` so that no group spans two folds and folds are of similar size.

    Groups larger than ``share`` of a fold, of which there can be at most
    folds / share, are dealt largest first to the lightest fold. Smaller groups
    cannot unbalance a fold; they fill the folds up in hash order. Rows without a
    group are one group.
    """
    sizes = written_once(df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")))
    total = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    bound = share * total / folds
    heavy = sizes.filter(F.col("__n") > bound).orderBy(F.col("__n").desc(), F.col(group)).collect()
    load = [0] * folds
    dealt = []
    for r in heavy:
        f = min(range(folds), key=lambda i: load[i])
        load[f] += r["__n"]
        dealt.append((r[group], f))
    # room of each fold as a share of all light rows
    level = max(max(load), -(-total // folds))
    room = [level - x for x in load]
    light_total = total - sum(load)
    edges, seen = [], 0.0
    for x in room[:-1]:
        seen += x * light_total / max(1, sum(room))
        edges.append(seen)
    schema = f"__g {sizes.schema[group].dataType.simpleString()}, __f int"
    fixed = df.sparkSession.createDataFrame(dealt, schema)
    light = sizes.filter(F.col("__n") <= bound).withColumn(
        # 53 bits of the hash as a number; groups that share it stay together
        "__o", F.shiftright(F.xxhash64(F.col(group).cast("string")), 11).cast("double")
    )
    if edges and light_total:
        curve = running_totals(light, "__o", {"n": F.sum("__n")})
        middle = F.col("cum_n") - F.col("n") / 2
        placed = curve.select(
            F.col("__o").alias("__oo"),
            sum([(middle >= e).cast("int") for e in edges], F.lit(0)).alias("__f"),
        )
        light_folds = light.join(placed, F.col("__o") == F.col("__oo")).select(F.col(group).alias("__g"), "__f")
    else:
        light_folds = light.select(F.col(group).alias("__g"), F.lit(0).alias("__f"))
    table = fixed.unionByName(light_folds)
    return df.join(table, F.col(group).eqNullSafe(F.col("__g"))).withColumn("fold", F.col("__f").cast("int")).drop("__g", "__f")
