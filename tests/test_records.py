"""Windows by arithmetic, references that must exist, record checks, run masks and suppression against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sensorloom.operators import boxes as B
from sensorloom.operators import checks as C
from sensorloom.operators import detect as D
from sensorloom.operators import masks as M
from sensorloom.operators import raster as R
from sensorloom.operators import scene as S
from sensorloom.operators.grouped import whole_groups


def test_windows_by_arithmetic_equal_generated_ones(spark):
    scenes = spark.range(1, 61).select(F.col("id").alias("scene_token"), F.col("id").cast("int").alias("n"))
    samples = scenes.select("scene_token", F.col("n").alias("scene_samples"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sample_index"))
    for size, stride in ((7, 3), (13, 9), (1, 1), (5, 5), (4, 1), (9, 8)):
        ranges = S.windows(scenes, size, stride).collect()
        want = {(r.scene_token, r.window_id, i, r.used_start <= i < r.used_end) for r in ranges for i in range(r.window_start, r.window_end)}
        rows = S.in_windows(samples, size, stride)
        got = {tuple(r) for r in rows.select("scene_token", "window_id", "sample_index", "used").collect()}
        assert got == want, (size, stride)
        first = {}
        for scene, k, i, used in want:
            if used:
                first[scene, i] = min(k, first.get((scene, i), k))
        assert {(r.scene_token, r.sample_index): r.window_id for r in S.used_window(samples, size, stride).collect()} == first
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0
    with pytest.raises(ValueError):
        S.window_ids(F.lit(1), F.lit(2), 3, 4)


def rig(spark, poses=(1, 2), sensors=(0,)):
    data = spark.createDataFrame([(1, 10, 1, 0), (2, 10, 2, 0), (3, 99, 7, 0)], "token long, sample_token long, ego_pose_token long, calibrated_sensor_token long")
    samples = spark.createDataFrame([(10, 1, 5)], "sample_token long, scene_token long, sample_ts long")
    pose = "qw double, qx double, qy double, qz double, tx double, ty double, tz double"
    ego = spark.createDataFrame([(p, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for p in poses], "token long, " + pose)
    sensor = spark.createDataFrame([(s, "CAM_FRONT", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for s in sensors], "sensor_id long, channel string, " + pose)
    return data, samples, ego, sensor


def test_frames_need_their_pose_and_sensor(spark):
    assert S.frames(*rig(spark)).count() == 2  # the third is of no sample, and goes
    with pytest.raises(PySparkException, match="record 2 has no ego pose 2"):
        S.frames(*rig(spark, poses=(1,))).collect()
    for used in (lambda rows: rows.where("channel = 'CAM_FRONT'").select("token"), lambda rows: rows.select("token"), lambda rows: rows.groupBy("sample_token").count()):
        with pytest.raises(PySparkException, match="no ego pose 2"):  # however little of it is used
            used(S.frames(*rig(spark, poses=(1,)))).collect()
    with pytest.raises(PySparkException, match="no calibrated sensor 0"):
        S.frames(*rig(spark, sensors=(5,))).where("channel = 'CAM_FRONT'").collect()
    lost = S.orphans(*rig(spark, poses=(1,), sensors=(5,))).collect()
    assert sorted(map(tuple, lost)) == [(1, "calibrated_sensor", "0"), (2, "calibrated_sensor", "0"), (2, "ego_pose", "2"), (3, "calibrated_sensor", "0"), (3, "ego_pose", "7"), (3, "sample", "99")]


def test_annotations_need_their_category(spark):
    notes = spark.createDataFrame([(1, 5), (2, 6)], "instance_token long, category_token long")
    kinds = spark.createDataFrame([(5, "vehicle.car", "car", 0, "vehicle")], "category_token long, name string, category_name string, id int, category_group string")
    with pytest.raises(PySparkException, match="record 2 has no category 6"):
        B.labelled(notes, kinds).collect()
    assert B.labelled(notes.where("category_token = 5"), kinds).first().label == "car"


def test_scene_by_name(spark):
    scenes = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "token string, name string")
    assert S.scene_named(scenes, "x").first().token == "a"
    with pytest.raises(PySparkException, match="no scene is named z"):
        S.scene_named(scenes, "z").collect()


def test_stacks_are_bounded(spark):
    rows = spark.createDataFrame([(1, k, f"i{k}") for k in (2, 0, 1)], "w int, i int, image string")
    assert S.window_stacks(rows, ["w"], ["i"], {"images": F.col("image")}, 3).first().images == ["i0", "i1", "i2"]
    with pytest.raises(PySparkException, match="over 2 rows"):
        S.window_stacks(rows, ["w"], ["i"], {"images": F.col("image")}, 2).collect()


def test_record_checks(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, None, 0.0, 1.0, 1.0), (3, float("nan"), 0.0, 1.0, 1.0), (4, 0.0, float("-inf"), 1.0, 1.0)], "k int, x0 double, y0 double, x1 double, y1 double")
    good, bad = C.split(rows, C.box_problems(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))
    assert [r.k for r in good.collect()] == [1] and sorted(r.k for r in bad.collect()) == [2, 3, 4]
    assert good.columns == rows.columns
    region = "struct<x0:int,y0:int,x1:int,y1:int>"
    kinds = [(1, [True] * 6, 3, 2, (0, 0, 3, 2)), (2, None, None, None, None), (3, [True] * 6, 3, 2, None), (4, None, None, None, (0, 0, 1, 1)), (5, [True] * 6, 2, 3, (0, 0, 3, 2)), (6, [True] * 5, 3, 2, (0, 0, 3, 2)), (7, [], 0, 2, (1, 0, 1, 2))]
    rows = spark.createDataFrame(kinds, f"k int, mask array<boolean>, w int, h int, region {region}")
    found = {r.k: r.reasons for r in C.checked(rows, C.instance_problems(F.col("mask"), F.col("w"), F.col("h"), F.col("region"))).collect()}
    assert found[1] == found[2] == []
    assert found[3] == found[4] == ["mask and region come together"]
    assert found[5] == ["a mask has its region's width and height"]
    assert found[6] == ["a mask has a bit for each pixel"]
    assert found[7] == ["a region ends behind its start"]


def runs_of(mask):
    out = []
    for v, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(int), [0]])))
        out += [(v, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return out


def test_run_masks_against_arrays(spark):
    rng = np.random.default_rng(4)
    masks, others = [], []
    for k in range(60):
        h, w = int(rng.integers(1, 9)), int(rng.integers(1, 9))
        masks.append(rng.random((h, w)) < (0.0 if k == 0 else 1.0 if k == 1 else 0.5))
        others.append(rng.random((h, w)) < 0.3)
    rows = [(k, m.shape[1], m.shape[0], m.reshape(-1).tolist(), o.reshape(-1).tolist(), int(rng.integers(-4, 5)), int(rng.integers(-4, 5)), int(rng.integers(1, 14)), int(rng.integers(1, 14))) for k, (m, o) in enumerate(zip(masks, others, strict=True))]
    df = spark.createDataFrame(rows, "k int, w int, h int, bits array<boolean>, other array<boolean>, dx int, dy int, nw int, nh int")
    df = B.computed(df, m=M.encoded(F.col("bits"), F.col("w")), o=M.encoded(F.col("other"), F.col("w")))
    points = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.struct((i * 0.37 - 1).alias("x"), (i * 0.53 % 9 - 0.5).alias("y")))
    c = F.col
    out = df.select("*", M.decoded(c("m"), c("w"), c("h")).alias("back"), M.area(c("m")).alias("area"), M.region(c("m")).alias("region"), M.moved(c("m"), c("dx"), c("dy"), 7, 6).alias("moved"), M.resized(c("m"), c("w"), c("h"), c("nw"), c("nh")).alias("resized"), M.holds(c("m"), points).alias("inside"))
    out = M.united(out, F.array("m", "o", F.lit(None).cast(M.RUNS)), "both")
    for r in out.collect():
        m, o = masks[r.k], others[r.k]
        tuples = lambda x: [tuple(y) for y in x]
        assert tuples(r.m) == runs_of(m)
        assert r.back == m.reshape(-1).tolist()
        assert r.area == m.sum()
        ys, xs = np.nonzero(m)
        assert (r.region and tuple(r.region)) == ((xs.min(), ys.min(), xs.max() + 1, ys.max() + 1) if len(xs) else None)
        canvas = np.zeros((6, 7), bool)
        for y, x in zip(ys + r.dy, xs + r.dx, strict=True):
            if 0 <= y < 6 and 0 <= x < 7:
                canvas[y, x] = True
        assert tuples(r.moved) == runs_of(canvas)
        at = lambda n, old: np.clip(((np.arange(n) + 0.5) * old / n).astype(int), 0, old - 1)
        assert tuples(r.resized) == runs_of(m[at(r.nh, r.h)][:, at(r.nw, r.w)])
        assert tuples(r.both) == runs_of(m | o)
        for i, inside in enumerate(r.inside):
            x, y = int(np.floor(i * 0.37 - 1)), int(np.floor(i * 0.53 % 9 - 0.5))
            assert inside == (0 <= y < r.h and 0 <= x < r.w and bool(m[y, x])), (r.k, i)


def test_run_masks_of_nothing(spark):
    df = spark.createDataFrame([(None,), ([],)], "bits array<boolean>")
    got = M.united(B.computed(df, m=M.encoded(F.col("bits"), 3)), F.array("m"), "u").select("m", "u", M.region(F.col("m")).alias("r"), M.resized(F.col("m"), 1, 1, 2, 2).alias("n")).collect()
    assert [(r.m, r.u, r.r, r.n) for r in got] == [(None, [], None, None), ([], [], None, [])]


def plain_survivors(boxes, threshold):
    kept = []
    for i, b in enumerate(boxes):
        over = False
        for j in kept:
            a = boxes[j]
            lap = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
            over |= lap / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - lap) > threshold
        if not over:
            kept.append(i)
    return kept


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 60), st.sampled_from([0.0, 0.3, 0.6, 0.85]))
def test_survivors(seed, n, threshold):
    rng = np.random.default_rng(seed)
    low = rng.integers(0, 12, (n, 2)) / 4
    boxes = np.concatenate([low, low + rng.integers(1, 9, (n, 2)) / 4], axis=1)
    assert np.flatnonzero(D.survivors(boxes, threshold)).tolist() == plain_survivors(boxes.tolist(), threshold)


def test_suppression_of_many_groups(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(3000):
        x, y = rng.integers(0, 10, 2) / 2
        rows.append((int(rng.integers(0, 40)) if i % 50 else None, i, float(rng.integers(0, 9)), float(x), float(y), float(x) + 2, float(y) + 1.5))
    df = spark.createDataFrame(rows, "g int, query_idx int, score double, x0 double, y0 double, x1 double, y1 double").repartition(5)
    got = sorted((r.g is None, r.g, r.query_idx) for r in D.suppress(df, ["g"], 0.4).collect())
    want = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        want += [(g is None, g, own[i][1]) for i in plain_survivors([r[3:] for r in own], 0.4)]
    assert got == sorted(want)


def test_groups_are_whole_in_batches():
    keys = [0, 0, 1, 2, 2, 2, 2, None, None, 3]
    table = pa.table({"k": pa.array(keys), "v": pa.array(range(10))})
    for size in range(1, 11):
        out = [b.to_pydict() for b in whole_groups(iter(table.to_batches(max_chunksize=size)), ["k"])]
        assert [v for b in out for v in b["v"]] == list(range(10))
        for a, b in zip(out, out[1:], strict=False):
            assert set(a["k"]).isdisjoint(b["k"])


def test_voxel_colours_and_limits(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (1, 0.4, 0.0, 0.0, 0.0), (1, 5.0, 0.0, 0.0, 0.5)], "f int, x double, y double, z double, red double")
    got = sorted((r.ix, r.x, r.red, r.n_points) for r in R.voxels(rows, 1.0, ["f"], ("red",)).collect())
    assert got == [(0, 0.2, 0.5, 2), (5, 5.0, 0.5, 1)]
    with pytest.raises(PySparkException, match="too many cells"):
        R.voxels(rows.union(spark.createDataFrame([(1, 1e9, 0.0, 0.0, 0.0)])), 1.0, ["f"]).collect()


def test_box_stages_are_nested(spark):
    from sensorloom.plans.fixtures import Fixtures, K
    from sensorloom.plans.scene_queries import frames

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    rows = B.box_stages(S.in_channels(frames(fx), S.CAMERAS), fx.annotation, fx.category, K)
    n = rows.agg(*(F.count_if(c).alias(c) for c in ("mapped", "in_view", "projected")), F.count_if(F.expr("in_view AND NOT mapped")).alias("a"), F.count_if(F.expr("projected AND NOT in_view")).alias("b")).first()
    assert n.mapped > n.in_view >= n.projected > 0 and n.a == n.b == 0


def unbroadcast(spark, made):
    """The physical plan of a table where nothing large is broadcast, as text."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "6k")
    try:
        return made()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)


def test_frames_lie_by_sample_where_boxes_join_them(spark):
    from sensorloom.plans.fixtures import Fixtures, K
    from sensorloom.plans.scene_queries import frames

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    plan = unbroadcast(spark, lambda: B.box_stages(S.in_channels(frames(fx), S.CAMERAS), fx.annotation, fx.category, K))
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(sample_token" in line]
    assert len(moved) == 2  # records with their poses, and samples; neither frames nor boxes again
    assert "extents(CASE WHEN" in plan  # boxes out of view go to Python as nulls


def test_whole_boxes_have_the_extent_of_clipped_ones():
    rng = np.random.default_rng(3)
    n = 4000
    center, turned, sensor = rng.uniform((-12, -8, -2), (12, 8, 30), (n, 3)), rng.normal(size=(n, 4)), rng.normal(size=(n, 4))
    axes = B._axes(turned, sensor / np.linalg.norm(sensor, axis=1)[:, None], rng.uniform(0.5, 6, (n, 3)))
    size, focal, middle = (np.tile(v, (n, 1)) for v in ((1600.0, 900.0), (1266.0, 1266.0), (816.0, 491.0)))
    with np.errstate(all="ignore"):
        got, want = B._extents(center, axes, size, focal, middle, 0.1), B._seen_extents(center, axes, size, focal, middle, 0.1)
    assert np.allclose(got, want, rtol=0, atol=1e-9, equal_nan=True)
    assert 0 < np.isnan(want).any(1).sum() < n and ((want[:, :2] > 0).all(1) & (want[:, 2:] < size).all(1)).sum() > 500


def test_windows_move_a_row_once(spark):
    from sensorloom.plans.queries import QUERIES

    plan = unbroadcast(spark, lambda: QUERIES["a13_window_bundles"](spark, "/root/testdata/sf0.001"))
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(scene_token" in line]
    assert len(moved) == 2 and "window_id" not in "".join(moved)  # samples by scene, and frames by scene, camera and block


@pytest.mark.parametrize("size, stride", [(7, 3), (5, 5), (4, 1)])
def test_stacked_windows_equal_stacks_of_dealt_rows(spark, size, stride):
    rng = np.random.default_rng(5)
    lengths = {1: 1, 2: 6, 3: 7, 4: 250}
    samples = spark.createDataFrame([(s, c, i, n, f"{s}{c}{i}") for s, n in lengths.items() for c in "ab" for i in range(n) if c == "a" or rng.random() < 0.6], "s int, c string, sample_index int, scene_samples int, name string")
    got = S.stacked_windows(samples, ["s", "c"], ["name"], {"name": F.col("name")}, {"names": F.upper("name")}, size, stride)
    assert "used_start" in got.columns
    want = S.window_stacks(S.in_windows(samples, size, stride), ["s", "c", "window_id"], ["sample_index", "name"], {"names": F.upper("name"), "used": F.col("used")}, size)
    used = F.transform("rows", lambda r: (r["at"] >= F.col("used_start")) & (r["at"] < F.col("used_end")))
    got = got.select("s", "c", "window_id", F.col("rows.names").alias("names"), used.alias("used"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 80
    double = spark.createDataFrame([(1, "a", i, 9, f"{i}{k}") for i in range(9) for k in range(1 + (i == 2))], samples.schema)
    with pytest.raises(PySparkException, match=f"over {size} rows"):
        S.stacked_windows(double, ["s", "c"], ["name"], {"name": F.col("name")}, {"name": F.col("name")}, size, stride).collect()


def test_boxes_get_their_track_where_they_lie(spark):
    from sensorloom.plans.queries import QUERIES

    plan = unbroadcast(spark, lambda: QUERIES["f21_global_boxes"](spark, "/root/testdata/sf0.001"))
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if "instance_token" in line]  # boxes of frames don't move to their instance
    rows = spark.createDataFrame([(1, 10, "b", 0, 5), (1, 10, "a", 0, 4), (1, 10, "b", 0, 3), (1, 11, "a", 1, 0), (1, 11, "c", 1, 1), (2, 12, "c", 0, 1), (2, 12, None, 0, 0), (None, 13, "a", 0, 0)], "scene int, sample_token int, inst string, i int, k int")
    of = {(r.scene, r.inst): r.tracking_id for r in S.tracking_ids(rows, "scene", "inst", ["i", "k"]).collect()}
    got = {r.sample_token: r.ids for r in S.sample_tracking_ids(rows, "scene", "inst", ["i", "k"]).collect()}
    assert got == {10: {"b": of[1, "b"], "a": of[1, "a"]}, 11: {"a": of[1, "a"], "c": of[1, "c"]}, 12: {"c": of[2, "c"]}}


def test_a_box_goes_to_python_as_one_value(spark):
    from sensorloom.plans.queries import QUERIES

    plan = unbroadcast(spark, lambda: QUERIES["f20_p16_all_boxes_2d_counts"](spark, "/root/testdata/sf0.001"))
    assert "extents(array(" in plan and "hax" not in plan  # its axes are made there
