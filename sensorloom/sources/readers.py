"""Readers of driving-dataset files: record tables, lidar sweeps and images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt, parts_for, shuffles_freed
from .formats import register

_POSE = "translation array<double>, rotation array<double>"
#: Schemas of the record tables, declared so that no pass over the files infers them; a table comes after those that it points to.
SCHEMAS = {
    "scene": "token string, name string",
    "sample": "token string, scene_token string, timestamp bigint",
    "sensor": "token string, channel string",
    "calibrated_sensor": f"token string, sensor_token string, {_POSE}, camera_intrinsic array<array<double>>",
    "ego_pose": f"token string, {_POSE}",
    "sample_data": "token string, sample_token string, ego_pose_token string, calibrated_sensor_token string, is_key_frame boolean, filename string, width int, height int, timestamp bigint",
    "category": "token string, name string",
    "instance": "token string, category_token string",
    "sample_annotation": f"token string, sample_token string, instance_token string, size array<double>, {_POSE}",
}
#: What the converted tables hold besides, of the records that theirs point to (null where there is none).
RESOLVED = {
    "calibrated_sensor": "channel string",
    "sample_data": "channel string",
    "sample_annotation": "has_instance boolean, category_token string",
}
#: Raw category -> (name, id, group) of the ten detection classes (fixed values).
CATEGORIES = [
    ("vehicle.car", "car", 0, "vehicle"),
    ("vehicle.truck", "truck", 1, "vehicle"),
    ("vehicle.construction", "construction_vehicle", 2, "vehicle"),
    ("vehicle.bus.bendy", "bus", 3, "vehicle"),
    ("vehicle.bus.rigid", "bus", 3, "vehicle"),
    ("vehicle.trailer", "trailer", 4, "vehicle"),
    ("movable_object.barrier", "barrier", 5, "road_object"),
    ("vehicle.motorcycle", "motorcycle", 6, "two_wheeler"),
    ("vehicle.bicycle", "bicycle", 7, "two_wheeler"),
    ("human.pedestrian.adult", "pedestrian", 8, "pedestrian"),
    ("human.pedestrian.child", "pedestrian", 8, "pedestrian"),
    ("human.pedestrian.construction_worker", "pedestrian", 8, "pedestrian"),
    ("human.pedestrian.police_officer", "pedestrian", 8, "pedestrian"),
    ("movable_object.trafficcone", "traffic_cone", 9, "road_object"),
]


def read_table(spark: SparkSession, folder: str, name: str, parts: bool = False) -> DataFrame:
    """A record table; one JSON array per file can't be split, so convert to Parquet once with convert_tables.

    parts: the table is a folder of such files.
    """
    return spark.read.schema(SCHEMAS[name]).option("multiLine", True).json(f"{folder}/{name}" + ("" if parts else ".json"))


def converted(spark: SparkSession, out: str, name: str, resolved: bool = True) -> DataFrame:
    """A table that convert_table wrote."""
    more = [RESOLVED[name]] if resolved and name in RESOLVED else []
    return spark.read.schema(", ".join([SCHEMAS[name], *more])).parquet(f"{out}/{name}")


def with_category(notes: DataFrame, instances: DataFrame) -> DataFrame:
    """Annotations with what RESOLVED says of them."""
    return looked_up(notes, "instance_token", instances.select(F.col("token").alias("_token"), F.lit(True).alias("has_instance"), "category_token"))


#: Rows of a table that each task gets whole to look records up in, at most.
FEW = 20_000


def looked_up(rows: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """rows with what `other` (one row a token, _token) has of the record that their key names; null where there is none.

    A task holds a few records of `other`, or its part of them, and rows stream past: nothing is sorted.
    """
    n = other.count()
    at = F.col(key) == F.col("_token")
    if n <= FEW:
        return rows.join(F.broadcast(other), at, "left").drop("_token")
    parts = parts_for(n)
    return dealt(rows, parts, key).join(dealt(other, parts, "_token").hint("shuffle_hash"), at, "left").drop("_token")


def convert_table(spark: SparkSession, folder: str, out: str, name: str, parts: bool = False, resolved: bool = True) -> None:
    """A record table as Parquet, with what RESOLVED says; the tables that it points to were converted before.

    Annotations meet their instances here, once, and what that moved is freed: queries move them to their samples only. Where no
    boxes are asked for, resolved=False spares that; dataset.open_tables then joins them when they are.
    """
    other = lambda n, *columns: converted(spark, out, n).select(F.col("token").alias("_token"), *columns)
    with shuffles_freed(spark):
        rows = read_table(spark, folder, name, parts)
        if name == "calibrated_sensor":
            rows = looked_up(rows, "sensor_token", other("sensor", "channel"))
        elif name == "sample_data":
            rows = looked_up(rows, "calibrated_sensor_token", other("calibrated_sensor", "channel"))
        elif name == "sample_annotation" and resolved:
            rows = with_category(rows, converted(spark, out, "instance"))
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}")


def convert_tables(spark: SparkSession, folder: str, out: str, parts: bool = False, resolved: bool = True) -> None:
    """All record tables as Parquet, once; dataset.open_tables reads them."""
    for name in SCHEMAS:
        convert_table(spark, folder, out, name, parts, resolved)


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "name string, category_name string, id int, category_group string")


def read_sweeps(spark: SparkSession, pattern: str) -> DataFrame:
    """Lidar files of little-endian float32 records (x, y, z, intensity, ring), one row per point; a broken tail is an error."""

    def points(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                table = np.frombuffer(content, "<f4").reshape(-1, 5)
                yield pd.DataFrame(table, columns=["x", "y", "z", "intensity", "ring"]).assign(path=path, point_idx=np.arange(len(table), dtype=np.int32))[["path", "point_idx", "x", "y", "z", "intensity", "ring"]]

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(points, "path string, point_idx int, x float, y float, z float, intensity float, ring float")


def read_images(spark: SparkSession, folder: str, ending: str = ".png") -> DataFrame:
    """Image files with their number in name order (nth, from 0); bytes stay as they are for a predictor to decode.

    Numbers come from the listing of formats.Images, so nothing is sorted or joined.
    """
    register(spark)
    return spark.read.format("image_files").option("ending", ending).load(folder).select("path", "filename", "content", "nth")
