"""What operators need of the session: the package on Python workers, and tables stored in the folder that all executors share."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that goes to a Python worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Shuffle files of a job go when it ends; else they lie until the driver collects garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a task sorts or holds, about: some 100 MB of records or boxes.
ROWS = 250_000
ROOT = str(Path(__file__).resolve().parents[1])


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where the repository is on a path that they can read; bound their batches.

    Clusters that don't share the path ship the package with --py-files instead; then this changes nothing that matters.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if spark.conf.get(BATCH) == "67108864b":  # Spark's default; a user's own setting stays
        spark.conf.set(BATCH, "16m")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one of our own in local mode only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file:///tmp/sensorloom-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs that store their result leave no shuffle files behind."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def parts_for(n: int) -> int:
    """Parts of a table of n rows in which a task sorts them in memory."""
    return -(-n // ROWS)


def dealt(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Rows dealt by their keys to so many parts, if Spark would make fewer of them (and sort them on disk)."""
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def new_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored_table(df: DataFrame, what: str, by: list[str] | None = None) -> DataFrame:
    """The rows written as Parquet to the shared folder (in a folder for each value of `by`) and read back: computed once, of known size."""
    path = new_path(df.sparkSession, what)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
