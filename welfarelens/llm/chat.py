"""Chat formatting: logged conversations that are prefixes of longer ones collapse, the rest are rendered.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from welfarelens.llm.tables import stored

#: Turns numbered together and rendered into one row.
BLOCK = 256
_NO_ID = -(2**63)


def _lane(number: int) -> Column:
    return F.xxhash64(F.lit(number), "pos", "role", "body")


def positions(conversations: DataFrame) -> DataFrame:
    """``key``, ``pos`` (from 0), ``role`` and ``body`` of every turn, with its ``block`` and whether it is the ``last``.

    Turns are ordered by ``turn`` (nulls first), role and text. A conversation is cut into blocks by turn number, blocks
    are counted and the counts summed up, so that no task sorts a long conversation whole.
    """
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_ID)).alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.nullif(F.lower(F.trim(F.col("role").cast("string"))), F.lit("")), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(_NO_ID)))
    counts = rows.groupBy("key", "block").agg(F.count(F.lit(1)).alias("rows"))
    blocks = Window.partitionBy("key").orderBy("block")
    counts = counts.select(
        "key", "block", "rows", (F.sum("rows").over(blocks) - F.col("rows")).alias("base"),
        F.lead("block").over(blocks).isNull().alias("last_block"),
    )
    within = Window.partitionBy("key", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    numbered = rows.withColumn("number", F.row_number().over(within)).join(counts, ["key", "block"])
    return numbered.select(
        "key", "block", (F.col("base") + F.col("number") - 1).alias("pos"), "role", "body",
        (F.col("last_block") & (F.col("number") == F.col("rows"))).alias("last"),
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``key``, ``length``, ``a`` and ``b``: the rolling hash of each prefix, with ``last`` for whole conversations.

    The hash of a prefix is the exclusive or of its turns' hashes, each of which includes the turn's position. It has
    two lanes of 64 bits and cannot overflow, however many turns there are.
    """
    rows = turns.withColumn("a", _lane(1)).withColumn("b", _lane(2))
    totals = rows.groupBy("key", "block").agg(F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"))
    blocks = Window.partitionBy("key").orderBy("block")
    before = totals.select("key", "block", *[F.bit_xor(c).over(blocks).bitwiseXOR(F.col(c)).alias(c) for c in ("ta", "tb")])
    within = Window.partitionBy("key", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ra", F.bit_xor("a").over(within)).withColumn("rb", F.bit_xor("b").over(within))
    return rows.join(before, ["key", "block"]).select(
        "key", (F.col("pos") + 1).alias("length"), F.col("ra").bitwiseXOR(F.col("ta")).alias("a"), F.col("rb").bitwiseXOR(F.col("tb")).alias("b"), "last"
    )


def maximal(turns: DataFrame) -> DataFrame:
    """``key`` of each conversation that is no proper prefix of another; of equal ones the smallest key."""
    hashes = stored(prefix_hashes(turns), "prefixes")
    whole = hashes.filter("last").groupBy("length", "a", "b").agg(F.min("key").alias("key"))
    proper = hashes.filter(~F.col("last")).select("length", "a", "b").distinct()
    return whole.join(proper, ["length", "a", "b"], "left_anti").select("key")


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``part``, ``turns`` and ``text``: every maximal conversation rendered, ``BLOCK`` turns to a row.

    A conversation whose turns are the first turns of a longer one goes, and so does all but the one with the smallest
    id of equal ones. Roles are trimmed and in lower case, null or empty ones "unknown"; a null text is empty;
    "<|" in a text becomes "< |" so that it cannot pass for a mark. Turns with equal numbers stay, ordered by role and
    text. Rows without a conversation id form one conversation. Other columns are ignored; an empty table gives an
    empty one. A conversation longer than ``BLOCK`` turns continues in its next part, so no row grows without bound.
    """
    turns = stored(positions(conversations), "turns")
    kept = turns.join(maximal(turns), "key", "left_semi")
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "body", F.lit("<|im_end|>\n"))
    parts = kept.groupBy("key", F.floor(F.col("pos") / BLOCK).alias("part")).agg(
        F.count(F.lit(1)).alias("turns"), F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines")
    )
    conv_id = F.when(F.col("key") != _NO_ID, F.col("key")).alias("conv_id")
    return parts.select(conv_id, "part", "turns", F.array_join(F.col("lines.line"), "").alias("text"))
