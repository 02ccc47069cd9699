"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and the executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing and all runs on one machine, as in local tests, the context gets a temporary one.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", ""):
        return folder
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fernwell-checkpoint-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames that are made and run within remove their shuffle files when they have ended, where Spark can do so."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
