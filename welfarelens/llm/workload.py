"""Queries of the operators in this subpackage, and the SQL they are checked against where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from welfarelens.llm import alignment, chat, decontamination, jaccard, neighbours, packing, passages, quality, resample, sharding, simhash, token_files, toxicity
from welfarelens.llm.labelled import held_out
from welfarelens.llm.tables import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add if fn is None else add(fn)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in the token-id files and the checksum of its ids, read back from the files."""
    folder = new_folder(spark, "token-files")
    token_files.write_token_files(
        table(spark, sf, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2
    )
    read = token_files.read_token_files(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's SimHash fingerprint and near-duplicate component."""
    found = simhash.near_duplicates(table(spark, sf, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    sql="""
WITH named AS (
  SELECT coalesce(conv_id, -9223372036854775808) AS k, turn,
         coalesce(nullif(lower(trim(role)), ''), 'unknown') AS r, replace(coalesce(text, ''), '<|', '< |') AS x
  FROM conversations),
turns AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, r, x) - 1 AS pos,
         '<|im_start|>' || r || chr(10) || x || '<|im_end|>' || chr(10) AS line
  FROM named),
whole AS (SELECT k, list(line ORDER BY pos) AS lines FROM turns GROUP BY k),
copies AS (SELECT min(k) AS k, lines FROM whole GROUP BY lines),
prefixes AS (SELECT DISTINCT lines[1:n] AS lines FROM (SELECT lines, unnest(range(1, len(lines))) AS n FROM copies)),
kept AS (SELECT k FROM copies c WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.lines = c.lines))
SELECT CASE WHEN k <> -9223372036854775808 THEN k END AS conv_id, pos // 256 AS part, count(*) AS turns,
       string_agg(line, '' ORDER BY pos) AS text
FROM turns WHERE k IN (SELECT k FROM kept) GROUP BY k, pos // 256"""
)
def op3_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Every logged conversation that is no prefix of another, rendered for training."""
    return chat.format_chats(table(spark, sf, "conversations"))


@query
def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of a document and its place in a training sequence."""
    pieces = packing.pack(
        table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=2048
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = table(spark, sf, "documents")
    model = toxicity.train_toxicity(docs, table(spark, sf, "labels"))
    scored = docs.select("doc_id", toxicity.toxicity_score(model, F.col("text"), spark).alias("score"))
    return _decided(scored, 0.5)


@query
def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's quality score."""
    docs = table(spark, sf, "documents")
    model = quality.train_quality(docs, table(spark, sf, "labels"))
    scored = docs.select("doc_id", quality.quality_score(model, F.col("text"), spark).alias("score"))
    return _decided(scored, model.cut)


def _decided(scored: DataFrame, threshold: float) -> DataFrame:
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


@query
def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's shard and slot; equal texts stay together and shards have nearly equal bytes."""
    placed = sharding.shard_by_bytes(table(spark, sf, "documents"), shards=24)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op8_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return neighbours.nearest_neighbours(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, nearest=5)


@query
def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return decontamination.find_overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op10_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage of a document that repeats one of an earlier document."""
    return passages.repeated_passages(table(spark, sf, "documents"))


@query
def op11_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's component among documents whose shingle sets are similar."""
    return jaccard.jaccard_components(table(spark, sf, "documents"), shingle=3, percent=90)


@query
def op12_resample(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's importance weight for the benchmark's word distribution, its noisy score and rank if drawn."""
    return resample.importance_resample(
        table(spark, sf, "documents"), table(spark, sf, "benchmark"), buckets=10_000, longest=1, percent=10, least_words=20, seed=2024
    )


@query
def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's alignment of two tokenizers and how common its linked pairs of ids are."""
    return alignment.align_tokens(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
