"""Session helpers shared by the tests, the benchmark and the library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A small local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("welfarelens")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions, the natural number of range buckets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only a local session without one
    gets a temporary folder; on a cluster that would be lost with the machine, so
    there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="welfarelens-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def intermediate_folder(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table; ``drop_intermediates`` deletes it."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _INTERMEDIATES.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


#: Folders of intermediate tables by application.
_INTERMEDIATES: dict[str, list[str]] = {}


def drop_intermediates(spark: SparkSession) -> int:
    """Delete all intermediate tables this session has written and return their number.

    Results that have not been written or collected yet read some of them, so this is for the end of a run.
    """
    sc = spark.sparkContext
    folders = _INTERMEDIATES.pop(sc.applicationId, [])
    for folder in folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


def written_once(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read by any number of later steps."""
    spark = df.sparkSession
    folder = intermediate_folder(spark, "table")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def held_small(df: DataFrame) -> DataFrame:
    """A table with a row per grid point or run, computed once and kept in the plan. Not for tables that grow with data."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, which may not find it by themselves. Done once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_welfarelens_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="welfarelens-"), "welfarelens_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(home)))
    sc.addPyFile(archive)
    sc._welfarelens_shipped = True
