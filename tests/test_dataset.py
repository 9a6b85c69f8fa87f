"""A dataset of record files opened as tables: frames, boxes by each camera's own intrinsics, files of records, broken references."""

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sensorloom.functions.pose import own_intrinsics
from sensorloom.operators import boxes as B
from sensorloom.operators import scene as S
from sensorloom.sources import dataset, readers

LEVEL = {"translation": [0.0, 0.0, 0.0], "rotation": [1.0, 0.0, 0.0, 0.0]}
#: Looks along the vehicle's x axis: camera x is its right, y down.
AHEAD = {"translation": [0.0, 0.0, 0.0], "rotation": [0.5, -0.5, 0.5, -0.5]}


def camera(f):
    return [[f, 0.0, 800.0], [0.0, f, 450.0], [0.0, 0.0, 1.0]]


def records():
    frames = [("f1", "p1", "c1", True, "img/a.png"), ("f2", "p1", "c2", True, "img/b.png"), ("f3", "p1", "l1", True, "top/a.bin"), ("f4", "p1", "c1", False, "img/none.png")]
    return {
        "scene": [{"token": "s2", "name": "one"}, {"token": "s1", "name": "one"}, {"token": "s3", "name": "two"}],
        "sample": [{"token": "a", "scene_token": "s1", "timestamp": 1_500_000}, {"token": "b", "scene_token": "s2", "timestamp": 1}],
        "sample_data": [{"token": t, "sample_token": "a", "ego_pose_token": p, "calibrated_sensor_token": c, "is_key_frame": key, "filename": name, "width": 1600, "height": 900, "timestamp": 1_500_000} for t, p, c, key, name in frames],
        "ego_pose": [{"token": "p1", **LEVEL}],
        "calibrated_sensor": [{"token": "c1", "sensor_token": "x1", **AHEAD, "camera_intrinsic": camera(1000.0)}, {"token": "c2", "sensor_token": "x2", **AHEAD, "camera_intrinsic": camera(500.0)}, {"token": "l1", "sensor_token": "x3", **LEVEL, "camera_intrinsic": []}],
        "sensor": [{"token": "x1", "channel": "CAM_FRONT"}, {"token": "x2", "channel": "CAM_BACK"}, {"token": "x3", "channel": "LIDAR_TOP"}],
        "sample_annotation": [{"token": "n1", "sample_token": "a", "instance_token": "i1", "size": [2.0, 4.0, 2.0], **LEVEL, "translation": [12.0, 0.0, 0.0]}, {"token": "n2", "sample_token": "a", "instance_token": "i2", "size": [1.0, 1.0, 1.0], **LEVEL, "translation": [9.0, 1.0, 0.0]}],
        "instance": [{"token": "i1", "category_token": "k1"}, {"token": "i2", "category_token": "k2"}],
        "category": [{"token": "k1", "name": "vehicle.car"}, {"token": "k2", "name": "animal"}],
    }


def opened(spark, path, tables):
    (path / "json").mkdir()
    for name, rows in tables.items():
        (path / "json" / f"{name}.json").write_text(json.dumps(rows))
    readers.convert_tables(spark, f"file://{path}/json", f"file://{path}/tables")
    return dataset.open_tables(spark, f"file://{path}/tables")


def test_boxes_by_each_cameras_own_intrinsics(spark, tmp_path):
    data = opened(spark, tmp_path, records())
    got = {r.token: (r.annotation_token, r.label, r.x0, r.y0, r.x1, r.y1) for r in data.boxes_2d().collect()}
    assert set(got) == {"f1", "f2"}  # key frames of cameras
    for token, f in (("f1", 1000), ("f2", 500)):  # a car 4 long, 2 wide and high, its near face 10 ahead
        assert got[token][:2] == ("n1", "car")
        assert got[token][2:] == pytest.approx((800 - f / 10, 450 - f / 10, 800 + f / 10, 450 + f / 10))
    assert {r.label for r in data.boxes(keep_unmapped=True).collect()} == {"car", "animal"}
    assert data.frames(key_frames=False).count() == 4 and data.frames().count() == 3
    assert str(data.sample.where("sample_token = 'a'").first().sample_ts) == "1970-01-01 00:00:01.500000"


def test_rows_may_have_different_intrinsics(spark):
    """Per-row columns give what the same numbers as constants give."""
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.uniform(-8, 8, 2)), float(rng.uniform(0, 20)), *map(float, rng.uniform(0.5, 4, 3)), float(400 + 300 * (i % 3)), float(500 + 100 * (i % 3)), 700.0 + i % 3, 400.0 - i % 3) for i in range(120)]
    names = "i int, bx double, by double, bz double, sl double, sw double, sh double, kfx double, kfy double, kcx double, kcy double"
    frame = spark.createDataFrame(rows, names).withColumns({f"{p}{c}": F.lit(1.0 if c == "w" else 0.0) for p in ("sq", "bq") for c in "wxyz"} | {f"st{c}": F.lit(0.0) for c in "xyz"} | {"width": F.lit(1600), "height": F.lit(900)})
    corners = lambda some: {r.i: (r.x0, r.y0, r.x1, r.y1) for r in some.collect()}
    want = {}
    for k in range(3):
        want |= corners(B.boxes_2d(frame.where(f"i % 3 = {k}"), (400.0 + 300 * k, 500.0 + 100 * k, 700.0 + k, 400.0 - k)))
    assert len(want) > 40 and corners(B.boxes_2d(frame, own_intrinsics())) == want


def test_files_of_records(spark, tmp_path):
    data = opened(spark, tmp_path, records())
    files = tmp_path / "files"
    for folder in ("img", "top"):
        (files / folder).mkdir(parents=True)
    (files / "img/a.png").write_bytes(b"A")
    (files / "img/b.png").write_bytes(b"")
    np.arange(10, dtype="<f4").tofile(files / "top/a.bin")
    assert sorted((r.token, r.channel, bytes(r.content)) for r in data.images(f"file://{files}").collect()) == [("f1", "CAM_FRONT", b"A"), ("f2", "CAM_BACK", b"")]
    points = data.points(f"file://{files}").orderBy("point_idx").collect()
    assert [tuple(r) for r in points] == [("f3", "a", 0, 0, 1, 2, 3, 4), ("f3", "a", 1, 5, 6, 7, 8, 9)]
    with pytest.raises(PySparkException, match="none.png"):  # the record that is no key frame has no file
        data.images(f"file://{files}", key_frames=False).count()
    (files / "top/a.bin").write_bytes(b"12345")
    with pytest.raises(PySparkException, match="top/a.bin ends inside a point"):
        data.points(f"file://{files}").count()


def test_one_scene(spark, tmp_path):
    data = opened(spark, tmp_path, records())
    assert [r.sample_token for r in data.of_scene("one").sample.collect()] == ["a"]  # the first of two scenes of the name
    assert data.of_scene("one").frames().count() == 3 and data.of_scene("two").frames().count() == 0
    with pytest.raises(PySparkException, match="no scene is named three"):
        data.of_scene("three").frames().collect()


@pytest.mark.parametrize(
    ("table", "change", "message"),
    [
        ("instance", {"token": "other"}, "record n1 has no instance i1"),
        ("sensor", {"token": "other"}, "record c1 has no sensor x1"),
        ("category", {"token": "other"}, "no category k1"),
        ("ego_pose", {"token": "other"}, "record f[0-9] has no ego pose p1"),
        ("ego_pose", {"rotation": [1.0, 0.0]}, "a rotation has 4 numbers: record p1"),
        ("sample_annotation", {"translation": None}, "a translation has 3 numbers: record n1"),
        ("calibrated_sensor", {"camera_intrinsic": [[1.0, 0.5, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]}, "intrinsics with skew or of another form: record c1"),
    ],
)
def test_broken_records_are_named(spark, tmp_path, table, change, message):
    tables = records()
    tables[table][0] |= change
    with pytest.raises(PySparkException, match=message):
        opened(spark, tmp_path, tables).boxes_2d().collect()


def test_empty_tables(spark, tmp_path):
    data = opened(spark, tmp_path, {name: [] for name in records()})
    assert data.boxes_2d().count() == 0 and data.points(f"file://{tmp_path}").count() == 0


def test_windows_hold_each_cameras_own_calibration(spark, tmp_path):
    tables = records()
    tables["sample"] = [{"token": f"t{i}", "scene_token": "s1", "timestamp": 500_000 * i} for i in range(5)]
    tables["sample_data"] = [{**tables["sample_data"][0], "token": f"d{i}{c}", "sample_token": f"t{i}", "calibrated_sensor_token": c, "filename": f"{c}/{i}", "timestamp": 500_000 * i} for i in range(5) for c in ("c1", "c2", "l1")]
    tables["sample_annotation"] = []
    data = opened(spark, tmp_path, tables)
    rows = {(r.channel, r.window_id): r for r in data.windows(3, 2).collect()}
    assert set(rows) == {(c, w) for c in ("CAM_FRONT", "CAM_BACK") for w in (0, 1)}  # [0, 3) and [2, 5)
    one = rows["CAM_BACK", 1]
    assert one.images == ["c2/2", "c2/3", "c2/4"] and one.frame_rate == pytest.approx(2.0)
    assert rows["CAM_FRONT", 0].used == [True, True, False] and one.used == [True, True, True]  # a frame's first window is used
    assert one.intrinsics == [camera(500.0)] * 3 and rows["CAM_FRONT", 0].intrinsics == [camera(1000.0)] * 3
    assert tuple(one.to_global[0]) == pytest.approx((0.5, -0.5, 0.5, -0.5, 0, 0, 0)) and tuple(one.from_global[0]) == pytest.approx((0.5, 0.5, -0.5, 0.5, 0, 0, 0))
    top = S.window_bundles(data.frames(["LIDAR_TOP"]), 10, 5).first()
    assert len(top.tokens) == 5 and top.intrinsics == [None] * 5
