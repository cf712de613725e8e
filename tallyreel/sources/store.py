"""Shared storage, and rows that several jobs read."""

import os
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the checkpoint folder, else the warehouse."""
    named = spark.conf.get(SETTING, None) or spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is ever overwritten there."""
    return f"{shared_folder(spark)}/tallyreel/{name}-{uuid.uuid4().hex}"


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    Enough where all machines have it at one path; else it goes along as ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def settle(rows: DataFrame, name: str) -> DataFrame:
    """Rows that several later jobs read, computed once.

    Where the session names a checkpoint folder they are written there and read back:
    the files, unlike cached blocks, outlive a lost executor. They stay until the owner of
    that folder clears it. Without the setting the rows are persisted, spilling to
    disk, until the session ends or clears its cache; lost blocks are computed anew.
    """
    if not rows.sparkSession.conf.get(SETTING, None):
        return rows.persist(StorageLevel.MEMORY_AND_DISK)
    path = fresh_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
