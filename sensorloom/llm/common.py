"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ROOT = str(Path(__file__).resolve().parents[2])


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


#: The lists that scratch() fills, for this thread's context.
_made: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Collects the paths that fresh_path gives inside. At the end, those still in the list are deleted (what isn't in it stays).

    For jobs whose result is stored by then: nothing may read the deleted paths any more. After an error nothing is deleted.
    """
    paths: list[str] = []
    token = _made.set((*_made.get(), paths))
    try:
        yield paths
    finally:
        _made.reset(token)
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)  # any store that Spark reaches
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    for paths in _made.get():
        paths.append(path)
    return path


def as_uri(path: str) -> str:
    """The path with its scheme, as pyarrow's file systems want it."""
    return path if "://" in path else f"file://{path}"


def fresh_name(df: DataFrame, what: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken, name = {c.lower() for c in df.columns}, what
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: cuts lineage and gives Spark true sizes."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], what: str) -> DataFrame:
    """stored(make(), what); what make() stored on its way is deleted then, so nothing else may read it."""
    with scratch(spark) as paths:
        df = make()
        path = fresh_path(spark, what)
        df.write.parquet(path)
        paths.remove(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """left.join(right, key, how), inner or left, where a few keys may hold most rows of left; right has a key once at most.

    left is read twice, so it is stored or cheap. Keys with more than 1 / (8 * partitions) of its rows meet their rows of right
    where they are: those rows are broadcast, fewer than 8 for each partition.
    """
    spark = left.sparkSession
    hot_name = fresh_name(left, "hot")
    limit = left.count() / (8 * partitions(spark))
    hot_keys = left.groupBy(key).agg(F.count("*").alias(hot_name)).where(F.col(hot_name) > limit)
    hot = stored(right.join(F.broadcast(hot_keys), key), "hot-rows")
    marked = left.join(F.broadcast(hot), key, "left")
    others = marked.where(F.col(hot_name).isNull()).select(*[left[c] for c in left.columns]).join(right.hint("merge"), key, how)
    return marked.where(F.col(hot_name).isNotNull()).drop(hot_name).unionByName(others)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
