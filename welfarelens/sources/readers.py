"""Readers. Schemas are explicit wherever the caller knows them."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column, once on load: the two mean the same here."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header. Without a schema every column is text; nothing is inferred."""
    reader = spark.read.options(header=True, **options)
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.csv(path))


def read_csv_columns(spark: SparkSession, path: str, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Only the listed columns, renamed by position. The scan reads no others."""
    quoted = [F.col(f"`{c}`") for c in columns]
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path).select(*quoted).toDF(*names)


def read_indicator_csv(spark: SparkSession, path: str, code_column: str = "Country Code") -> DataFrame:
    """Wide indicator CSV whose header follows a few lines of preamble.

    The header of a file is its first row with ``code_column`` in the place it has there; every row below it is kept,
    whatever its code. Year columns come back as DOUBLE (unreadable cells NULL), the rest as text. A file without a
    header gives no rows, and an error if no file has one.
    """
    lines = spark.read.text(path).filter(F.col("value").contains(code_column))
    cells = [next(csv.reader([r["value"].rstrip(",\r")])) for r in lines.limit(HEADER_CANDIDATES).collect()]
    names = next((c for c in cells if code_column in c), None)
    if names is None:
        raise ValueError(f"no header line with {code_column!r} in {path}")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    data = spark.read.schema(schema).options(header=False, mode="PERMISSIVE").csv(path)
    placed = data.select(*data.columns, F.col("_metadata.file_path").alias("__file"), _row_place().alias("__place"))
    code = f"c{names.index(code_column)}"
    # one row per file
    heads = placed.filter(F.trim(code) == code_column).groupBy("__file").agg(F.min("__place").alias("__head"))
    below = placed.join(heads, "__file").filter(F.col("__place") > F.col("__head")).select(*data.columns).toDF(*names)
    return below.select(
        *[
            F.expr(f"try_cast(`{n}` as double)").alias(n) if re.fullmatch(r"\d{4}", n) else F.col(f"`{n}`")
            for n in names
        ]
    )


#: Lines with the name of the code column that are looked at for the header.
HEADER_CANDIDATES = 100


def _row_place() -> Column:
    """Place of a row: its file, the file's block and the row's order in it."""
    return F.struct(
        F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("i"),
    )


def year_columns(df: DataFrame) -> list[str]:
    """Names that are four digits, in order."""
    return sorted(c for c in df.columns if re.fullmatch(r"\d{4}", c))


def plain_year_headers(df: DataFrame) -> DataFrame:
    """Rename '2021 [YR2021]' to '2021' and read the year columns as numbers (unreadable cells NULL)."""
    renamed = df.toDF(*[re.sub(r"^(\d{4}) \[YR\d{4}\]$", r"\1", c) for c in df.columns])
    years = set(year_columns(renamed))
    return renamed.select(
        *[F.expr(f"try_cast(`{c}` as double)").alias(c) if c in years else F.col(f"`{c}`") for c in renamed.columns]
    )


def read_parquet(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet file, folder or glob, optionally only some columns."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    return nan_to_null(df.select(*columns) if columns else df)


def newest_file(spark: SparkSession, glob: str) -> str:
    """Path with the largest 8-digit date before its extension. Lists names only, opens no file."""
    row = (
        spark.read.format("binaryFile")
        .load(glob)
        .select("path", F.regexp_extract("path", r"_(\d{8})(?:\.[A-Za-z]+)?(?:/[^/]*)?$", 1).alias("day"))
        .filter(F.col("day") != "")
        .agg(F.max_by(F.struct("path", "day"), F.struct("day", "path")).alias("top"))
        .first()["top"]
    )
    if row is None:
        raise FileNotFoundError(f"no dated file matches {glob}")
    # a dated folder of part files is returned as the folder
    return re.sub(rf"({row['day']}(?:\.[A-Za-z]+)?)/[^/]*$", r"\1", row["path"])


def source_path() -> Column:
    """Path of the file a row was read from."""
    return F.col("_metadata.file_path")


ENTITY_FILE = r"/([^/]+)/([^/]+)/([^/]+)\.parquet"


def entity_files(
    spark: SparkSession, root: str, parts: Sequence[str] = ("train", "test"), folders: Sequence[str] = ("cleaned", "clean")
) -> DataFrame:
    """(entity, folder, part) of every file ``<root>/<entity>/<folder>/<part>.parquet``. Lists names, opens no file.

    An entity with several of ``folders`` has the first of them only.
    """
    glob = f"{root}/*/{{{','.join(folders)}}}/{{{','.join(parts)}}}.parquet"
    found = spark.read.format("binaryFile").load(glob).select("path")
    names = ["entity", "folder", "part"]
    found = found.select(*[F.regexp_extract("path", ENTITY_FILE, i + 1).alias(n) for i, n in enumerate(names)]).distinct()
    rank = F.array_position(F.array(*[F.lit(f) for f in folders]), F.col("folder"))
    first = found.groupBy("entity").agg(F.min_by("folder", rank).alias("folder"))
    return found.join(first, ["entity", "folder"])


def read_entities(
    spark: SparkSession,
    root: str,
    parts: Sequence[str] = ("train", "test"),
    folders: Sequence[str] = ("cleaned", "clean"),
    columns: Sequence[str] | None = None,
    skip_unreadable: bool = False,
) -> DataFrame:
    """All ``<root>/<entity>/<folder>/<part>.parquet`` as one table with entity and part columns.

    One scan instead of a loop over folders. A file that cannot be read is an
    error, or with ``skip_unreadable`` is left out; ``entity_gaps`` then names what
    is missing. Columns that only some entities have are NULL for the others. An
    entity with several of ``folders`` uses the first of them.
    """
    glob = f"{root}/*/{{{','.join(folders)}}}/{{{','.join(parts)}}}.parquet"
    df = spark.read.options(mergeSchema=True, ignoreCorruptFiles=skip_unreadable).parquet(glob)
    keep = columns or df.columns
    df = df.select(
        *keep,
        F.regexp_extract(source_path(), ENTITY_FILE, 1).alias("entity"),
        F.regexp_extract(source_path(), ENTITY_FILE, 2).alias("folder"),
        F.regexp_extract(source_path(), ENTITY_FILE, 3).alias("part"),
    )
    return df.join(entity_files(spark, root, parts, folders), ["entity", "folder", "part"], "left_semi").drop("folder")


def entity_gaps(files: DataFrame, table: DataFrame, parts: Sequence[str] = ("train", "test")) -> DataFrame:
    """(entity, part, problem) of the parts that give no row: 'no file' or 'no rows' (empty or unreadable)."""
    wanted = files.select("entity").distinct().withColumn("part", F.explode(F.array(*[F.lit(p) for p in parts])))
    have = files.select("entity", "part", F.lit(True).alias("__file"))
    missing = wanted.join(table.select("entity", "part").distinct(), ["entity", "part"], "left_anti")
    problem = F.when(F.col("__file"), F.lit("no rows")).otherwise(F.lit("no file"))
    return missing.join(have, ["entity", "part"], "left").select("entity", "part", problem.alias("problem"))


# name of a file without its extension
FILE_STEM = r"([^/]+)\.[^./]+$"


def read_tagged(
    spark: SparkSession, path: str, schema: T.StructType | str, tag: str, pattern: str = FILE_STEM
) -> DataFrame:
    """CSV files with a piece of each row's path as column ``tag``, by default the file stem."""
    piece = F.regexp_extract(source_path(), pattern, 1)
    return spark.read.schema(schema).options(header=True).csv(path).select("*", F.url_decode(piece).alias(tag))


def above_first_blank_row(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a CSV above its first row of only empty cells (all rows if there is none).

    A folder of sorted part files counts as one text in the order of the file names.
    """
    df = spark.read.schema(schema).options(header=True).csv(path)
    names = df.columns
    # rows keep their order inside a block, and blocks are ordered by their start
    placed = df.select(
        *names,
        _row_place().alias("__pos"),
    )
    blank = F.lit(True)
    for c in names:
        blank = blank & F.col(c).isNull()
    cut = placed.filter(blank).agg(F.min("__pos").alias("__cut"))
    return (
        placed.crossJoin(F.broadcast(cut))
        .filter(F.col("__cut").isNull() | (F.col("__pos") < F.col("__cut")))
        .select(*names)
    )


def read_with_position(spark: SparkSession, path: str, schema: T.StructType | str, position: str = "position") -> DataFrame:
    """CSV rows with their 0-based place in the text, so that files without an id can be joined row by row.

    A folder of sorted part files counts as one text in the order of the file names. Rows are counted per block of a
    file, and only the block counts are summed up in one task.
    """
    df = spark.read.schema(schema).options(header=True).csv(path)
    names = df.columns
    placed = df.select(*names, _row_place().alias("__p")).select(*names, "__p.f", "__p.b", "__p.i")
    counts = placed.groupBy("f", "b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("f", "b")) - F.col("__n")
    starts = counts.select("f", "b", before.alias("__start"))
    number = F.row_number().over(Window.partitionBy("f", "b").orderBy("i")) - 1
    numbered = placed.withColumn("__number", number).join(starts, ["f", "b"])
    return numbered.select(*names, (F.col("__start") + F.col("__number")).alias(position))


def join_by_position(left: DataFrame, right: DataFrame, position: str = "position") -> DataFrame:
    """Rows at the same place of two texts side by side; an error if the texts differ in length."""
    sizes = [t.agg(F.count(F.lit(1))).first()[0] for t in (left, right)]
    if sizes[0] != sizes[1]:
        raise ValueError(f"{sizes[0]} rows on the left, {sizes[1]} on the right")
    return left.join(right, position)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result table grown by ``append_result``: columns matched by name, missing ones NULL."""
    return spark.read.options(mergeSchema=True).parquet(path)
