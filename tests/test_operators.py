"""Closed-form checks of the perception operators."""

import json
import math
import struct
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sensorloom.functions import pose as Q
from sensorloom.functions import predict
from sensorloom.functions.pose import Pose, Quat, Vec
from sensorloom.operators import boxes as B
from sensorloom.operators import detect as D
from sensorloom.operators import raster as R
from sensorloom.operators import scene as S
from sensorloom.sources import readers, sinks


def quat(w, x, y, z):
    return Quat(*(F.lit(float(c)) for c in (w, x, y, z)))


def vec(*xyz):
    return Vec(*(F.lit(float(c)) for c in xyz))


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_rotation_by_ninety_degrees(spark):
    q = Q.from_yaw(F.lit(math.pi / 2))
    assert one(spark, *Q.rotate(q, vec(1, 0, 0))) == pytest.approx((0, 1, 0))
    assert one(spark, Q.yaw(q))[0] == pytest.approx(math.pi / 2)


def test_pose_round_trip(spark):
    pose = Pose(Q.normalized(quat(1, 2, 3, 4)), vec(5, 6, 7))
    assert one(spark, *Q.apply_inverse(pose, Q.apply(pose, vec(1, 2, 3)))) == pytest.approx((1, 2, 3))
    assert one(spark, *Q.apply(Q.invert(pose), Q.apply(pose, vec(1, 2, 3)))) == pytest.approx((1, 2, 3))


def test_zero_quaternion_is_an_error(spark):
    with pytest.raises(PySparkException):
        one(spark, *Q.normalized(Quat(*(F.col("id") * 0.0 for _ in range(4)))))


def test_unit_cube_corners(spark):
    cube = Q.corners(vec(0, 0, 0), vec(2, 2, 2), quat(1, 0, 0, 0))
    got = [one(spark, *c) for c in cube]
    assert got == [tuple(float(x) for x in s) for s in Q.CORNER_SIGNS]


@pytest.mark.parametrize(("n", "size", "stride", "starts"), [(11, 7, 3, [0, 3, 4]), (5, 7, 3, [0]), (7, 7, 3, [0]), (13, 7, 3, [0, 3, 6]), (40, 13, 9, [0, 9, 18, 27])])
def test_window_starts(spark, n, size, stride, starts):
    rows = S.windows(spark.createDataFrame([(1, n)], "scene_token long, n int"), size, stride).orderBy("window_id").collect()
    assert [r.window_start for r in rows] == starts
    used = [i for r in rows for i in range(r.used_start, r.used_end)]
    assert set(used) == set(range(n))
    with pytest.raises(ValueError):
        S.windows(spark.createDataFrame([(1, n)], "scene_token long, n int"), 3, 4)


def test_prompt_example(spark):
    rows = spark.createDataFrame([(0, 0, "cat"), (0, 1, " Dog. "), (0, 2, "bird"), (0, 3, "dog"), (0, 4, " . ")], "g int, pos int, label string")
    prompts = D.prompt_labels(rows, ["g"])
    assert [(r.label, r.span_start, r.span_end) for r in prompts.orderBy("nth").collect()] == [("cat", 0, 3), ("dog", 5, 8), ("bird", 10, 14)]
    assert D.captions(prompts, ["g"]).first().caption == "cat. dog. bird."
    clash = D.prompt_labels(spark.createDataFrame([(0, 0, "a_b"), (0, 1, "a b")], "g int, pos int, label string"), ["g"])
    assert D.conflicts(clash, ["g"]).first().phrase == "a b"


def test_suppression(spark):
    rows = [(1, i, s, float(x), 0.0, float(x) + 1, 1.0) for i, (s, x) in enumerate([(0.9, 0), (0.8, 0.1), (0.7, 0.5), (0.7, 5), (0.7, 5)])]
    out = D.suppress(spark.createDataFrame(rows, "g int, query_idx int, score double, x0 double, y0 double, x1 double, y1 double"), ["g"], 0.6)
    assert sorted(r.query_idx for r in out.collect()) == [0, 2, 3]


def boxes(spark, rows):
    """Boxes straight in camera coordinates: an identity rig."""
    names = "i int, bx double, by double, bz double, sl double, sw double, sh double, width int, height int"
    frame = spark.createDataFrame([(i, *map(float, r), 1600, 900) for i, r in enumerate(rows)], names)
    return frame.withColumns({f"{p}{c}": F.lit(1.0 if c == "w" else 0.0) for p in ("sq", "bq") for c in "wxyz"} | {f"st{c}": F.lit(0.0) for c in "xyz"})


def test_boxes_2d(spark):
    k = (1000.0, 1000.0, 800.0, 450.0)
    rows = [(0, 0, 10, 2, 2, 2), (0, 0, 0, 2, 2, 2), (0, 0, -5, 2, 2, 2), (100, 0, 10, 2, 2, 2), (0, 0, 1000, 0.1, 0.1, 0.1), (8, 0, 10, 4, 2, 2)]
    got = {r.i: (r.x0, r.y0, r.x1, r.y1) for r in B.boxes_2d(boxes(spark, rows), k).collect()}
    near = 1000 / 9
    assert got[0] == pytest.approx((800 - near, 450 - near, 800 + near, 450 + near))
    assert got[1] == pytest.approx((0, 0, 1600, 900))  # around the camera
    assert set(got) == {0, 1, 5}
    assert got[5][2] == 1600 and got[5][0] == pytest.approx(800 + 6000 / 11)


def test_erosion_and_dilation(spark):
    full = [(u, v) != (2, 2) for v in range(5) for u in range(5)]
    dot = [(u, v) == (0, 0) for v in range(5) for u in range(5)]
    rows = spark.createDataFrame([(full, dot)], "full array<boolean>, dot array<boolean>")
    got = rows.select(*(R.morphology(F.col(c), F.lit(5), F.lit(5), [k]).alias(c) for c, k in (("full", -3), ("dot", 3)))).first()
    places = lambda bits: {(p % 5, p // 5) for p, b in enumerate(bits) if b}
    assert places(got.full) == {(u, v) for u in range(5) for v in range(5)} - {(2, 2), (1, 2), (3, 2), (2, 1), (2, 3)}
    assert places(got.dot) == {(0, 0), (1, 0), (0, 1)}


def test_unknown_depth_model(spark):
    with pytest.raises(PySparkException):
        spark.range(1).select(R.metric_depth(F.col("id").cast("double"), F.concat(F.lit("m"), F.col("id")), 1.0, 1.0)).collect()


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/sensor.json").write_text(json.dumps([{"token": "a", "channel": "CAM_FRONT", "more": 1}]))
    assert [tuple(r) for r in readers.read_table(spark, f"{tmp_path}/in", "sensor").collect()] == [("a", "CAM_FRONT")]
    (tmp_path / "s.bin").write_bytes(struct.pack("<10f", *range(10)))
    assert [tuple(r)[1:] for r in readers.read_sweeps(spark, f"{tmp_path}/*.bin").orderBy("point_idx").collect()] == [(0, 0, 1, 2, 3, 4), (1, 5, 6, 7, 8, 9)]
    for name in ("b.png", "a.png", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"x")
    assert sorted((r.nth, r.filename, bytes(r.content)) for r in readers.read_images(spark, f"{tmp_path}/in").collect()) == [(0, "a.png", b"x"), (1, "b.png", b"x")]
    assert readers.categories(spark).count() == 14
    cloud = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 0.0, 0.5, 1.0), (0, 4.0, 5.0, 6.0, 1.0, 1.0, 1.0), (12, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1234, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (12345, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "frame_idx int, x double, y double, z double, red double, green double, blue double")
    sinks.write_ply(cloud.withColumn("i", -F.col("x")), f"{tmp_path}/ply", order="i")
    assert {f.name for f in Path(f"{tmp_path}/ply").glob("frame=*")} == {f"frame=point{n}" for n in ("0000", "0012", "1234", "12345")}
    (file,) = Path(f"{tmp_path}/ply/frame=point0000").glob("part-*")
    lines = file.read_text().splitlines()
    assert lines[:3] == ["ply", "format ascii 1.0", "element vertex 2"] and lines[9] == "end_header" and len(lines) == 12
    assert lines[10].startswith("4.0 ") and lines[11].startswith("1.0 ")
    results = spark.createDataFrame([("s", "CAM", "vehicle", 1), ("s", "CAM", "pedestrian", 2)], "scene_token string, channel string, category_group string, n int")
    for rows in (results, results, results.where("n = 2")):  # a job that is run again, and one with other rows
        sinks.write_results(rows, f"{tmp_path}/res")
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/res").where("channel = 'CAM'").collect()) == [1, 2]


def stand_ins():
    """A detector and a depth model, made inside so that they go to workers by value."""

    def stand_in_detector():
        """(image_id, content, caption) -> image_id, query_idx, logits, cx, cy, w, h: three boxes from a checksum."""

        def predict(frame):
            out = []
            for image, content, caption in zip(frame["image_id"], frame["content"], frame["caption"], strict=True):
                seed = np.random.default_rng(zlib.crc32(bytes(content) + caption.encode()))
                for k in range(3):
                    out.append((image, k, seed.normal(size=8).tolist(), *seed.uniform(0.2, 0.4, 4)))
            return pd.DataFrame(out, columns=["image_id", "query_idx", "logits", "cx", "cy", "w", "h"])

        return predict

    def stand_in_depth():
        """Frames of one window -> the same frames with a 2 x 2 depth map each, and how often this predictor was called before."""
        calls = []

        def predict(frame):
            frame = frame.sort_values("sample_index")
            calls.append(1)
            depth = [[float(i), float(len(calls) - 1), 2.0, float(len(frame))] for i in frame["sample_index"]]
            return pd.DataFrame({"scene_token": frame["scene_token"], "window_id": frame["window_id"], "sample_index": frame["sample_index"], "depth": depth})

        return predict

    return stand_in_detector, stand_in_depth


def test_predictors(spark):
    stand_in_detector, stand_in_depth = stand_ins()
    images = spark.createDataFrame([(i, bytes([i]), "cat.") for i in range(5)], "image_id long, content binary, caption string")
    out = predict.predict_rows(images, stand_in_detector, "image_id long, query_idx int, logits array<double>, cx double, cy double, w double, h double")
    assert out.count() == 15
    frames = spark.createDataFrame([(1, 0, i) for i in range(4)] + [(1, 1, i) for i in range(3, 6)], "scene_token long, window_id int, sample_index int")
    depth = predict.predict_windows(frames, ["scene_token", "window_id"], stand_in_depth, "scene_token long, window_id int, sample_index int, depth array<double>")
    assert {(r.window_id, r.depth[3]) for r in depth.collect()} == {(0, 4.0), (1, 3.0)}
    one_task = predict.predict_windows(frames.repartition(1), ["scene_token", "window_id"], stand_in_depth, "scene_token long, window_id int, sample_index int, depth array<double>")
    with_one = one_task.coalesce(1).select(F.col("depth")[1].alias("calls")).distinct()
    assert {r.calls for r in with_one.collect()} <= {0.0, 1.0}


def test_morphology_of_rows(spark):
    """Against one pixel at a time, on masks of several sizes; empty and null masks stay, also in parts of the mask's side."""
    rng = np.random.default_rng(3)
    rows = [(i, w, h, (rng.random(w * h) < 0.3).tolist()) for i, (w, h) in enumerate([(7, 5), (1, 9), (12, 12), (3, 1)])] + [(8, 4, 4, [False] * 16), (9, 2, 2, None)]
    frame = spark.createDataFrame(rows, "i int, w int, h int, bits array<boolean>")

    def step(mask, k):
        h, w = mask.shape
        out = np.zeros_like(mask)
        for v in range(h):
            for u in range(w):
                near = [mask[v + b, u + a] for a, b in R.ellipse(abs(k)) if 0 <= v + b < h and 0 <= u + a < w]
                out[v, u] = any(near) if k > 0 else all(near)
        return out

    for sizes, ratio in (([3, -5, 0, 4], False), ([-3], False), ([0.5, -0.3], True)):
        got = {r.i: r.m for r in frame.select("i", R.morphology(F.col("bits"), F.col("w"), F.col("h"), sizes, ratio).alias("m")).collect()}
        for i, w, h, bits in rows:
            if bits is None:
                assert got[i] is None
                continue
            mask = np.array(bits, bool).reshape(h, w)
            v, u = np.nonzero(mask)
            for k in sizes if len(v) else []:
                k = int(math.copysign(math.ceil(abs(k) * (np.ptp(v) + np.ptp(u) + 2) / 2), k)) if ratio and k else k
                mask = step(mask, k) if k else mask
            assert got[i] == mask.reshape(-1).tolist(), (i, sizes)


def test_instances_come_back_whole(spark):
    """Without crop and resizing nothing changes; an extreme shrinking leaves one pixel; normalized boxes are the default of boxes alone."""
    rows = spark.createDataFrame([(1, [0.0, 0.9, 0.2, 0.7, 0.0, 0.0]), (2, [0.0] * 6)], "i int, scores array<double>")
    found = R.mask_instances(rows, "scores", F.lit(3), F.lit(2))
    whole = R.instances_to_original(found, (3, 2)).collect()
    assert [(r.i, r.rx0, r.ry0, r.rx1, r.ry1, r.mask, r.x0, r.y1) for r in whole] == [(1, 0, 0, 2, 2, [False, True, True, False], 0.0, 2.0)]
    small = R.instances_to_original(found, (3, 2), (1, 0, 2, 1), (300, 200)).first()
    assert (small.rx0, small.ry0, small.rx1, small.ry1, len(small.mask)) == (1, 0, 2, 1, 1)
    box = B.box_to_original(tuple(F.lit(c) for c in (0.0, 0.5, 1.0, 1.0)), (1600, 900), (100, 100, 300, 200), (50, 50))
    assert one(spark, *box) == pytest.approx((100, 150, 300, 200))


def test_prompt_points_need_as_many_labels(spark):
    rows = spark.createDataFrame([([(1.0, 2.0)], [1, 0])], "points array<struct<x:double,y:double>>, labels array<int>")
    with pytest.raises(PySparkException):
        rows.select(*D.prompt_points(F.col("points"), F.col("labels"), tuple(F.lit(c) for c in (0, 0, 9, 9)))).collect()


def test_distinct_points_keep_the_first(spark):
    rows = spark.createDataFrame([([(1.0, 0.0), (1.0 + 1e-12, 0.0), (1.0 + 1e-9, 0.0), (1.0, 0.0)],)], "p array<struct<x:double,y:double>>")
    assert [p.x for p in rows.select(B.distinct_points(F.col("p"), ("x", "y")).alias("p")).first().p] == [1.0, 1.0 + 1e-9]


def test_rounding_by_a_scale(spark):
    from sensorloom.plans.registry import nearest

    values = [1020.7776934999999, 16459.0480325, -2.5e-6, 2.5e-6, -1e-9, 0.0, 1e17, -1e300, float("inf"), float("-inf"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(nearest("x", 6)).collect()]
    assert got == [1020.777694, 16459.048032, -3e-6, 3e-6, 0.0, 0.0, 1e17, -1e300, float("inf"), float("-inf"), None]  # as DuckDB's round
    assert spark.range(1).select(F.isnan(nearest(F.lit(float("nan")), 6))).first()[0]


def test_clipped_ends_are_those_of_clipped_points(spark):
    rng = np.random.default_rng(9)
    rows = [(i, *map(float, rng.uniform(-3, 3, 2)), float(rng.uniform(-3, 4)), *map(float, rng.uniform(0.5, 4, 3)), *map(float, rng.normal(size=4))) for i in range(200)]
    frame = spark.createDataFrame(rows, "i int, bx double, by double, bz double, sl double, sw double, sh double, gw double, gx double, gy double, gz double")
    frame = frame.withColumns(Q.normalized(Quat.of("g")).named("bq") | {f"sq{c}": F.lit(1.0 if c == "w" else 0.0) for c in "wxyz"} | {f"st{c}": F.lit(0.0) for c in "xyz"})
    want = {r.i: np.array([(p.x, p.y, p.z) for p in r.points]) for r in B.clipped_points(frame).collect()}
    got = {r.i: r for r in B.clipped_ends(frame).collect()}
    assert {i: r.n_ends for i, r in got.items()} == {i: len(p) for i, p in want.items()} and {0, 24} < {len(p) for p in want.values()}
    for i, points in want.items():
        mean = [got[i].end_x, got[i].end_y, got[i].end_z]
        assert mean == (pytest.approx(points.mean(0)) if len(points) else [None] * 3)


def test_boxes_are_turned_when_those_out_of_view_are_gone(spark):
    one = {"eqw": 1.0, "eqx": 0.0, "eqy": 0.0, "eqz": 0.0, "sqw": 1.0, "sqx": 0.0, "sqy": 0.0, "sqz": 0.0, **{p + c: 0.0 for p in ("et", "st", "q") for c in "xyz"}, "vx": 0.0, "vy": 0.0, "cx": 0.0, "cy": 0.0, "width": 1600, "height": 900}
    rows = lambda z, w: spark.range(1).select(*(F.lit(v).alias(c) for c, v in (one | {"cz": z, "qw": w}).items()))
    k = (1000.0, 1000.0, 800.0, 450.0)
    seen = B.seen_in_ego(rows(5.0, 2.0), k)
    assert seen.count() == 1 and B.seen_in_ego(rows(-5.0, 2.0), k).count() == 0
    plan = seen._jdf.queryExecution().analyzed().toString()
    assert plan.index("_rw") < plan.index("Filter")  # plans are written from the top
    for z in (5.0, -5.0):  # a rotation of length zero is an error in view or not
        with pytest.raises(PySparkException, match="length zero"):
            B.seen_in_ego(rows(z, 0.0), k).collect()
