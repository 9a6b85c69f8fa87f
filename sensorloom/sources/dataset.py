"""A driving dataset's record tables as the operators' tables, and its frames, boxes and files.

    readers.convert_tables(spark, "s3://.../v1.0", "s3://.../tables")   # once
    data = dataset.open_tables(spark, "s3://.../tables")
    boxes = data.boxes_2d()                                             # of every camera's key frame, by its own intrinsics

Records nest poses and sizes in arrays; here each number is a column, so that expressions stay in generated code and scans
read what they need. Annotations met their instances and records their channels at the conversion (readers.RESOLVED). Joins
are on tokens, between stored tables whose rows are counted, in as many parts as tasks can hold. What a record points to must
exist: a missing sensor, instance or category is an error that names it, when the record is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pose import OWN_INTRINSICS, own_intrinsics
from ..operators import boxes as B
from ..operators import scene as S
from ..operators.checks import required
from ..session import dealt, parts_for
from . import formats, readers


@dataclass
class Dataset:
    """The tables that operators take. Times are timestamps, sizes (width, length, height), rotations scalar first."""

    scene: DataFrame
    sample: DataFrame
    sample_data: DataFrame
    ego_pose: DataFrame
    sensor: DataFrame
    annotation: DataFrame
    category: DataFrame
    #: sample_data with `_channel`, the channel of its sensor.
    records: DataFrame
    #: In how many parts records and boxes are dealt, so that tasks sort them in memory.
    parts: int

    def of_scene(self, name: str) -> Dataset:
        """The same with the samples of one scene only, the first of that name (no such scene is an error when rows are read)."""
        one = S.scene_named(self.scene, name).select(F.col("token").alias("scene_token"))
        return Dataset(self.scene, self.sample.join(F.broadcast(one), "scene_token"), self.sample_data, self.ego_pose, self.sensor, self.annotation, self.category, self.records, self.parts)

    def frames(self, channels: list[str] | None = None, key_frames: bool = True) -> DataFrame:
        """Records of sensors with their sample, pose and intrinsics: key frames, unless all are asked for."""
        rows = self.records.where("is_key_frame") if key_frames else self.records
        if channels is not None:  # records of other sensors don't move; those without a sensor become an error
            rows = rows.where(F.col("_channel").isin(channels) | F.col("_channel").isNull())
        posed = readers.looked_up(rows.drop("_channel"), "ego_pose_token", self.ego_pose.select(F.col("token").alias("_token"), *S.raw_pose(), F.lit(True).alias("_pose")))
        rows = S.placed(posed, self.sample, self.sensor, self.parts)
        return rows if channels is None else S.in_channels(rows, channels)

    def boxes(self, keep_unmapped: bool = False) -> DataFrame:
        """Annotations with label and group; those without a class go, or keep their raw name."""
        return B.labelled(self.annotation, self.category, keep_unmapped)

    def boxes_in_view(self, channels: list[str] | None = None, near: float = 0.1) -> DataFrame:
        """Boxes whose centre is in the image, of each camera's key frame."""
        return B.seen_in_ego(B.frame_boxes(self.frames(channels or S.CAMERAS), dealt(self.boxes(), self.parts, "sample_token")), own_intrinsics(), near)

    def boxes_2d(self, channels: list[str] | None = None, near: float = 0.1, min_size: float = 1.0) -> DataFrame:
        """Their boxes in the image."""
        return B.boxes_2d(self.boxes_in_view(channels, near), own_intrinsics(), near, min_size)

    def windows(self, size: int, stride: int, channels: list[str] | None = None) -> DataFrame:
        """Sliding windows of each camera's key frames, as a depth model takes them: see scene.window_bundles."""
        return S.window_bundles(self.frames(channels or S.CAMERAS), size, stride, parts=self.parts)

    def points(self, folder: str, channel: str = "LIDAR_TOP", key_frames: bool = True, keys: tuple[str, ...] = ("token", "sample_token"), packed: bool = False) -> DataFrame:
        """Points of one lidar's frames from their files below folder: columns of the frames (keys), point_idx, x, y, z, intensity, ring.

        Poses may be among the keys, so that points need no join to be moved. packed: the folder holds formats.packed_sweeps.
        """
        rows = self.frames([channel], key_frames)
        if packed:
            return formats.points_in(rows, rows.sparkSession.read.schema(formats.PACK).parquet(folder), list(keys))
        return formats.points_of(rows, folder, list(keys))

    def images(self, folder: str, channels: list[str] | None = None, key_frames: bool = True) -> DataFrame:
        """Bytes of the cameras' frames from their files below folder: token, sample_token, channel, content."""
        return formats.contents_of(self.frames(channels or S.CAMERAS, key_frames), folder, ["token", "sample_token", "channel"])


def pose_columns() -> list[Column]:
    """translation and rotation as tx, ty, tz and qw, qx, qy, qz; arrays of another length are an error."""

    def part(name: str, n: int, i: int) -> Column:
        whole = F.size(name) == n
        return F.when(whole, F.get(name, F.lit(i))).otherwise(F.raise_error(F.concat(F.lit(f"a {name} has {n} numbers: record "), "token")).cast("double"))

    return [*(part("translation", 3, i).alias("t" + c) for i, c in enumerate("xyz")), *(part("rotation", 4, i).alias("q" + c) for i, c in enumerate("wxyz"))]


def intrinsic_columns() -> list[Column]:
    """camera_intrinsic, a 3 x 3 array, as its four numbers; null for sensors that have none. Skew is an error (pose.project_matrix takes it)."""
    k = F.col("camera_intrinsic")
    at = lambda i, j: F.get(F.get(k, F.lit(i)), F.lit(j))
    plain = (at(0, 1) == 0) & (at(1, 0) == 0) & (at(2, 0) == 0) & (at(2, 1) == 0) & (at(2, 2) == 1)
    bad = F.raise_error(F.concat(F.lit("intrinsics with skew or of another form: record "), "token")).cast("double")
    number = lambda c: F.when(F.coalesce(F.size(k), F.lit(0)) <= 0, None).when(F.coalesce(plain, F.lit(False)), c).otherwise(bad)
    return [number(at(i, j)).alias(n) for n, (i, j) in zip(OWN_INTRINSICS, ((0, 0), (1, 1), (0, 2), (1, 2)), strict=True)]


def open_tables(spark: SparkSession, folder: str, classes: DataFrame | None = None, resolved: bool = True) -> Dataset:
    """The Parquet tables that readers.convert_tables wrote, as a Dataset.

    classes: raw category name -> category_name, id, category_group (name once each); by default readers.categories. A raw
    category that it lacks has no class. Annotations have no velocity of their own: vx and vy are null. resolved: as the tables
    were converted (annotations meet their instances there, or here).
    """
    raw = {name: readers.converted(spark, folder, name) for name in readers.SCHEMAS}
    time = F.timestamp_micros("timestamp")
    sample = raw["sample"].select(F.col("token").alias("sample_token"), "scene_token", time.alias("sample_ts"))
    record = [*("token", "sample_token", "ego_pose_token", "calibrated_sensor_token", "is_key_frame", "filename", "width", "height"), time.alias("sd_ts")]
    data = raw["sample_data"].select(*record)
    records = raw["sample_data"].select(*record, F.col("channel").alias("_channel"))
    rig = raw["calibrated_sensor"].select("token", "sensor_token", "channel", *pose_columns(), *intrinsic_columns())
    sensor = required(rig, {"channel": ("sensor", "sensor_token")}, "token", keep=True).withColumnRenamed("token", "sensor_id").drop("sensor_token")
    size = [F.get("size", F.lit(i)).alias(n) for i, n in enumerate(("sw", "sl", "sh"))]
    notes = raw["sample_annotation"] if resolved else readers.with_category(readers.converted(spark, folder, "sample_annotation", False), raw["instance"])
    notes = notes.select("token", "sample_token", "instance_token", "category_token", F.col("has_instance").alias("_instance"), *size, *pose_columns()).withColumnsRenamed({"t" + c: "c" + c for c in "xyz"})
    notes = required(notes, {"_instance": ("instance", "instance_token")}, "token")
    notes = notes.withColumnRenamed("token", "annotation_token").withColumns({c: F.lit(None).cast("double") for c in ("vx", "vy")})
    # Categories are some dozens; Spark can't tell the size of a join, and would deal annotations to a few hot categories.
    known = raw["category"].select(F.col("token").alias("category_token"), "name").join(F.broadcast(classes or readers.categories(spark)), "name", "left").hint("broadcast")
    pose = raw["ego_pose"].select("token", *pose_columns())
    return Dataset(raw["scene"], sample, data, pose, sensor, notes, known, records, parts_for(max(raw["sample_data"].count(), raw["sample_annotation"].count())))
