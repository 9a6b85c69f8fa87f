"""Sinks: keyed result stores and point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(results: DataFrame, path: str) -> None:
    """Detector results keyed by scene, channel and category group, so that a later pass reads only what it needs.

    A job replaces the keys that it has rows of and leaves others, so one that is run again doesn't write twice.
    """
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_token", "channel", "category_group").parquet(path)


def write_ply(points: DataFrame, path: str, order: str | None = None) -> None:
    """Coloured clouds as ASCII PLY, a folder of one file per frame (frame=point0000, ...): frame_idx, x, y, z, red, green, blue (0 to 1).

    A frame's points go to one task, behind their header and, if a column is named, in its order; frames are spread over tasks.
    """
    number = F.col("frame_idx").cast("string")
    name = F.concat(F.lit("point"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)).alias("frame")
    byte = lambda c: F.round(F.col(c) * 255).cast("int").cast("string")
    body = points.select(name, F.lit(1).alias("part"), F.concat_ws(" ", *(F.col(c).cast("string") for c in "xyz"), *(byte(c) for c in ("red", "green", "blue"))).alias("value"), (F.col(order) if order else F.lit(0)).alias("nth"))
    fields = "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue"))
    header = points.groupBy(name).agg(F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.count("*").cast("string"), F.lit("\n" + fields + "end_header")).alias("value")).select("frame", F.lit(0).alias("part"), "value")
    rows = header.unionByName(body, allowMissingColumns=True).repartition("frame").sortWithinPartitions("frame", "part", "nth")
    rows.select("frame", "value").write.mode("overwrite").partitionBy("frame").text(path)
