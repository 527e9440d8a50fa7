"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "flightlens") -> SparkSession:
    """A local session with the settings the library is tested under."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Put the repository on the Python workers' path.

    On a cluster the package is normally installed or passed by --py-files; this
    covers workers that share the driver's file system.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse's where that is unset.

    A warehouse on a local disk is no such folder unless all run on one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse + "/_flightlens"


#: Spark's setting by which a query's shuffle files are deleted when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def spent_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go with their end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and no lost executor takes it along."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    with spent_shuffles(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Deletes the files of stored frames that no later plan reads; other tables are refused."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if not re.search(r"/tables/[0-9a-f]{32}$", folder):
                raise ValueError(f"not a stored table: {folder}")
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
