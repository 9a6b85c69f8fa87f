"""Queries for the remaining operators: pose functions, clouds, sweeps, comparisons, prompts and crops."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pose as Q
from ..functions.pose import Pose, Quat, Vec
from ..operators import boxes as B
from ..operators import detect as D
from ..operators import raster as R
from ..operators import scene as S
from .raster_queries import BOX, DEPTH, K8, MASK, POINTS, THRESHOLDS, mask, raster, recursive, nms_sql, same_label, scored
from .registry import query, r6, rounded
from .scene_queries import BOXES, FRAMES, WIN, SI, frames, scene_windows, seen_boxes, unrotate

ANN = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
KEYS = ", ".join(ANN)


def rotate_sql(q: str, v: tuple[str, str, str], out: str) -> str:
    """SQL: v turned by the quaternion q? (as unrotate, with the other sign of the vector part)."""
    return unrotate(q, v, out).replace("(-(", "(+(")


@query("f1_normalize", f"SELECT {KEYS}, round(qw / sqrt(qw*qw + qz*qz), 6) + 0e0 AS w, round(qz / sqrt(qw*qw + qz*qz), 6) + 0e0 AS z FROM fx_annotation")
def _(fx):
    q = Q.normalized(Quat.of("q"))
    return fx.annotation.select(*ANN, *rounded(w=q.w, z=q.z))


@query("f2_f3_conjugate_multiply", "SELECT a.sample_token, round(avg(e.qw*a.qw + e.qz*a.qz), 6) AS w, round(avg(e.qw*a.qz - e.qz*a.qw), 6) + 0e0 AS z FROM fx_annotation a JOIN fx_ego_pose e ON e.token = a.sample_token * 10 GROUP BY 1")
def _(fx):
    ego = fx.ego_pose.where("token % 10 = 0").select((F.col("token") / 10).cast("long").alias("sample_token"), *(F.col("q" + c).alias("e" + c) for c in "wxyz"))
    q = Q.multiply(Q.conjugate(Quat.of("e")), Quat.of("q"))
    return fx.annotation.join(ego, "sample_token").groupBy("sample_token").agg(r6(F.avg(q.w)).alias("w"), r6(F.avg(q.z)).alias("z"))


@query("f4_rotation_matrix", f"SELECT {KEYS}, round((qw*qw - qz*qz) / (qw*qw + qz*qz), 6) + 0e0 AS m00, round(-2*qw*qz / (qw*qw + qz*qz), 6) + 0e0 AS m01, 1e0 AS m22 FROM fx_annotation")
def _(fx):
    m = Q.matrix(Q.normalized(Quat.of("q")))
    return fx.annotation.select(*ANN, *rounded(m00=m[0].x, m01=m[0].y, m22=m[2].z))


@query("f5_f6_yaw", f"SELECT {KEYS}, round(cos(atan2(qz, qw)), 6) + 0e0 AS w, round(sin(atan2(qz, qw)), 6) + 0e0 AS z FROM fx_annotation")
def _(fx):
    q = Q.from_yaw(Q.yaw(Q.normalized(Quat.of("q"))))
    return fx.annotation.select(*ANN, *rounded(w=q.w, z=q.z))


@query("f7_f9_apply_pose", "SELECT token, round(etx + (eqw*eqw - eqz*eqz) / (eqw*eqw + eqz*eqz) * stx - 2*eqw*eqz / (eqw*eqw + eqz*eqz) * sty, 6) + 0e0 AS x, round(ety + 2*eqw*eqz / (eqw*eqw + eqz*eqz) * stx + (eqw*eqw - eqz*eqz) / (eqw*eqw + eqz*eqz) * sty, 6) + 0e0 AS y, round(etz + stz, 6) AS z FROM (" + FRAMES + "SELECT * FROM fr)")
def _(fx):
    p = Q.apply(Pose(Quat.of("eq"), Vec.of("et")), Vec.of("st"))
    return frames(fx).select("token", *rounded(x=p.x, y=p.y, z=p.z))


@query("f8_invert_pose", "WITH f AS (" + FRAMES + "SELECT token, " + unrotate("eq", ("-etx", "-ety", "-etz"), "i") + " FROM fr) SELECT token, round(ix, 6) + 0e0 AS x, round(iy, 6) + 0e0 AS y, round(iz, 6) + 0e0 AS z FROM f")
def _(fx):
    t = Q.invert(Pose(Quat.of("eq"), Vec.of("et"))).t
    return frames(fx).select("token", *rounded(x=t.x, y=t.y, z=t.z))


CLOUD = "WITH f AS (" + FRAMES + "SELECT * FROM fr WHERE channel = 'LIDAR_TOP'), l AS (SELECT f.*, p.l_orderkey, p.l_linenumber, p.l_partkey, p.l_suppkey, p.x, p.y, p.z FROM fx_lidar p JOIN f USING (sample_token)), e AS (SELECT *, " + rotate_sql("sq", ("x", "y", "z"), "r") + " FROM l), g AS (SELECT *, " + rotate_sql("eq", ("rx + stx", "ry + sty", "rz + stz"), "g") + " FROM e) "


def lidar_ego(fx):
    rows = fx.lidar.join(frames(fx).where("channel = 'LIDAR_TOP'"), "sample_token")
    return rows.withColumns(Q.apply(Pose(Quat.of("sq"), Vec.of("st")), Vec.of("")).named("r"))


@query("f10_lidar_to_ego", CLOUD + f"SELECT {KEYS}, round(rx + stx, 6) + 0e0 AS x, round(ry + sty, 6) + 0e0 AS y, round(rz + stz, 6) + 0e0 AS z FROM e")
def _(fx):
    return lidar_ego(fx).select(*ANN, *rounded(x="rx", y="ry", z="rz"))


@query("c5_lidar_to_global", CLOUD + f"SELECT {KEYS}, round(gx + etx, 6) + 0e0 AS x, round(gy + ety, 6) + 0e0 AS y, round(gz + etz, 6) + 0e0 AS z FROM g")
def _(fx):
    p = Q.apply(Pose(Quat.of("eq"), Vec.of("et")), Vec.of("r"))
    return lidar_ego(fx).select(*ANN, *rounded(x=p.x, y=p.y, z=p.z))


@query("f11_ego_to_camera", BOXES + f"SELECT {KEYS}, round(px, 6) + 0e0 AS x, round(py, 6) + 0e0 AS y, round(pz, 6) + 0e0 AS z FROM ca WHERE channel = 'CAM_BACK'")
def _(fx):
    from .scene_queries import ego_boxes

    rows = B.to_camera(ego_boxes(fx).where("channel = 'CAM_BACK'"), Vec.of("b"))
    return rows.select(*ANN, *rounded(x="px", y="py", z="pz"))


@query("f12_compose_poses", "WITH f AS (" + FRAMES + "SELECT *, " + rotate_sql("eq", ("stx", "sty", "stz"), "c") + " FROM fr) SELECT token, round(cx + etx, 6) + 0e0 AS tx, round(cy + ety, 6) + 0e0 AS ty, round((eqw*sqw - eqz*sqz) / sqrt((eqw*eqw + eqz*eqz) * (sqw*sqw + sqx*sqx + sqy*sqy + sqz*sqz)), 6) + 0e0 AS qw FROM f")
def _(fx):
    both = Q.compose(Pose(Quat.of("eq"), Vec.of("et")), Pose(Quat.of("sq"), Vec.of("st")))
    return frames(fx).select("token", *rounded(tx=both.t.x, ty=both.t.y, qw=both.q.w))


@query("f13_project", BOXES + f"SELECT {KEYS}, round(u + 2e-7, 6) AS u FROM vw WHERE channel = 'CAM_FRONT' AND pz > 1")
def _(fx):
    from .scene_queries import ego_boxes

    rows = B.to_camera(ego_boxes(fx).where("channel = 'CAM_FRONT'"), Vec.of("b")).where("pz > 1")
    u, _v = Q.project(Vec.of("p"), (1266.0, 1266.0, 816.0, 491.0))
    return rows.select(*ANN, r6(u + 2e-7).alias("u"))


@query("f17_clip_segment", "SELECT vec_id, round(CASE WHEN a >= 0 THEN a ELSE 0 END, 6) + 0e0 AS z0, round(CASE WHEN a >= 0 THEN 1e0 ELSE 1e0 + (0 - a) / (b - a) END, 6) AS x0 FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings) WHERE a >= 0 OR b >= 0")
def _(fx):
    e = F.col("embedding")
    point = lambda x, z: F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y"), z.cast("double").alias("z"))
    p, _q, there = B.clip_near(point(1.0, e[0]), point(2.0, e[1]), 0.0)
    return fx.raw("embeddings").where(there).select("vec_id", r6(p["z"]).alias("z0"), r6(p["x"]).alias("x0"))


@query("f23_f24_rect_to_original", BOX + "SELECT frame_id, query_idx, round(x0 * 640 / 0.8e0 + 10, 4) AS x0, round(y0 * 480 / 0.5e0 + 20, 4) AS y0 FROM bx")
def _(fx):
    x0, y0, _a, _b = B.to_original(F.col("x0") * 640, F.col("y0") * 480, F.col("x1") * 640, F.col("y1") * 480, 0.8, 0.5, 10.0, 20.0)
    return scored(fx).select("frame_id", "query_idx", F.round(x0, 4).alias("x0"), F.round(y0, 4).alias("y0"))


@query("f25_region_to_original", MASK + "SELECT vec_id, CAST(floor(min(u) / 0.3e0) + 7 AS INTEGER) AS x0, CAST(greatest(ceil((max(u) + 1) / 0.3e0), floor(min(u) / 0.3e0) + 1) + 7 AS INTEGER) AS x1 FROM mk GROUP BY 1")
def _(fx):
    r = R.mask_regions(mask(fx), ["vec_id"])
    low, high = F.floor(F.col("x0") / 0.3), F.ceil(F.col("x1") / 0.3)
    return r.select("vec_id", (low + 7).cast("int").alias("x0"), (F.greatest(high, low + 1) + 7).cast("int").alias("x1"))


@query("f26_f27_intrinsics", DEPTH + "SELECT vec_id, u, v, round((u - (816e0 / 2 - 5)) * z / (1266e0 / 2), 6) + 0e0 AS x FROM dp WHERE mask")
def _(fx):
    k = R.cropped_intrinsics(R.scaled_intrinsics((1266.0, 1266.0, 816.0, 491.0), 0.5, 0.5), 5.0, 0.0)
    return R.depth_points(R.kept_pixels(raster(fx), mask=F.col("mask")), k).select("vec_id", "u", "v", r6("x").alias("x"))


@query("p21_crop_prompt_points", MASK + "SELECT vec_id, u - 2 AS u, v - 1 AS v FROM mk WHERE u - 2 BETWEEN 0 AND 3 AND v - 1 BETWEEN 0 AND 4")
def _(fx):
    moved = mask(fx).select("vec_id", (F.col("u") - 2).alias("u"), (F.col("v") - 1).alias("v"))
    return moved.where("u >= 0 AND u < 4 AND v >= 0 AND v < 5")


@query("p22_finite_points", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda e: NOT isfinite(e / nullif(e, 0)))) = 0")
def _(fx):
    ratio = lambda e: e.cast("double") / F.nullif(e.cast("double"), F.lit(0.0))
    return fx.raw("embeddings").where(F.forall("embedding", lambda e: F.coalesce(~F.isnan(ratio(e)) & (F.abs(ratio(e)) < float("inf")), F.lit(True)))).select("vec_id")


@query("p23_a9_min_box_size", MASK + "SELECT vec_id FROM mk GROUP BY 1 HAVING max(u) + 1 - min(u) >= 7 AND max(v) + 1 - min(v) >= 8")
def _(fx):
    return R.mask_regions(mask(fx), ["vec_id"]).where("x1 - x0 >= 7 AND y1 - y0 >= 8").select("vec_id")


@query("j4_sensor_channels", FRAMES + "SELECT channel, count(DISTINCT scene_token) AS n_scenes FROM fr GROUP BY 1")
def _(fx):
    return frames(fx).groupBy("channel").agg(F.count_distinct("scene_token").alias("n_scenes"))


@query("j7_left_label", "SELECT category_name IS NULL AS unmapped, count(*) AS n FROM fx_annotation LEFT JOIN fx_category USING (category_token) GROUP BY 1")
def _(fx):
    rows = fx.annotation.join(F.broadcast(fx.category.select("category_token", "category_name")), "category_token", "left")
    return rows.groupBy(F.col("category_name").isNull().alias("unmapped")).agg(F.count("*").alias("n"))


GROUPS = "(VALUES ('vehicle'), ('road_object'), ('two_wheeler'), ('pedestrian')) AS g(category_group)"


@query("j13_detection_spine", FRAMES + f"SELECT scene_token, channel, category_group, count(*) AS n FROM fr CROSS JOIN {GROUPS} WHERE channel LIKE 'CAM%' GROUP BY 1, 2, 3")
def _(fx):
    groups = F.explode(F.array(*(F.lit(g) for g in ("vehicle", "road_object", "two_wheeler", "pedestrian"))))
    return S.in_channels(frames(fx), S.CAMERAS).withColumn("category_group", groups).groupBy("scene_token", "channel", "category_group").agg(F.count("*").alias("n"))


@query("j15_refind_results", BOX + "SELECT d.frame_id, d.query_idx, coalesce(b.first_query, -1) AS first_query FROM fx_detection d LEFT JOIN (SELECT frame_id, label_idx, min(query_idx) AS first_query FROM bx WHERE score > 0.51e0 GROUP BY 1, 2) b ON b.frame_id = d.frame_id AND b.label_idx = d.query_idx % 4")
def _(fx):
    best = S.first_per(scored(fx).where("score > 0.51D"), ["frame_id", "label_idx"], ["query_idx"]).select("frame_id", "label_idx", F.col("query_idx").alias("first_query"))
    asked = fx.detection.select("frame_id", "query_idx", (F.col("query_idx") % 4).cast("int").alias("label_idx"))
    return asked.join(best.hint("merge"), ["frame_id", "label_idx"], "left").select("frame_id", "query_idx", F.coalesce("first_query", F.lit(-1)).alias("first_query"))


@query("j20_truth_against_detections", BOX + ", gt AS (SELECT sample_token % 10 * 900 AS frame_id, category_token % 4 AS label_idx, count(*) AS n_truth FROM fx_annotation GROUP BY 1, 2), dt AS (SELECT frame_id, label_idx, count(*) AS n_found FROM bx GROUP BY 1, 2) SELECT frame_id, label_idx, coalesce(n_truth, 0) AS n_truth, coalesce(n_found, 0) AS n_found FROM gt FULL JOIN dt USING (frame_id, label_idx)")
def _(fx):
    truth = fx.annotation.groupBy((F.col("sample_token") % 10 * 900).alias("frame_id"), (F.col("category_token") % 4).alias("label_idx")).agg(F.count("*").alias("n_truth"))
    found = scored(fx).groupBy(F.col("frame_id").cast("long"), F.col("label_idx").cast("long").alias("label_idx")).agg(F.count("*").alias("n_found"))
    return truth.join(found.hint("merge"), ["frame_id", "label_idx"], "full").select("frame_id", "label_idx", F.coalesce("n_truth", F.lit(0)).alias("n_truth"), F.coalesce("n_found", F.lit(0)).alias("n_found"))


@query("a10_distinct_points", "SELECT vec_id, len(list_distinct(list_transform(embedding, lambda e: round(CAST(e AS DOUBLE), 1) + 0e0))) AS n FROM embeddings")
def _(fx):
    return fx.raw("embeddings").select("vec_id", F.size(F.array_distinct(F.transform("embedding", lambda e: F.round(e.cast("double"), 1) + 0.0))).cast("long").alias("n"))


@query("a13_window_stacks", WIN.format(w=7, s=3, l=2) + SI + " SELECT scene_token, window_id, string_agg(CAST(sample_token AS VARCHAR), ',' ORDER BY sample_index) AS stack FROM si JOIN wi USING (scene_token) WHERE sample_index >= window_start AND sample_index < window_end GROUP BY 1, 2")
def _(fx):
    rows = S.in_windows(S.with_sample_index(fx.sample), 7, 3)
    stack = F.array_sort(F.collect_list(F.struct("sample_index", "sample_token")))
    return rows.groupBy("scene_token", "window_id").agg(F.array_join(F.transform(stack, lambda s: s["sample_token"].cast("string")), ",").alias("stack"))


@query("w7_window_counter", WIN.format(w=7, s=3, l=2) + " SELECT window_id, count(*) AS n FROM wi GROUP BY 1")
def _(fx):
    return scene_windows(fx, 7, 3).groupBy("window_id").agg(F.count("*").alias("n"))


GROUPED = "SELECT frame_id, query_idx, score, x0, y0, x1, y1, CASE WHEN label_idx < 2 THEN 'vehicle' ELSE '__label__:' || label_idx END AS nms_group FROM bx"


@query("d8_a15_exclusive_groups", recursive(BOX + nms_sql(f"({GROUPED})", "frame_id, nms_group", "0.6e0", "n1") + " SELECT frame_id, nms_group, query_idx FROM n1"))
def _(fx):
    group = F.when(F.col("label_idx") < 2, "vehicle").otherwise(F.concat(F.lit("__label__:"), F.col("label_idx")))
    rows = scored(fx).select("frame_id", group.alias("nms_group"), "query_idx", F.round("score", 12).alias("score"), "x0", "y0", "x1", "y1")
    return D.suppress(rows, ["frame_id", "nms_group"], 0.6).select("frame_id", "nms_group", "query_idx")


@query("d10_second_threshold", BOX + f"SELECT frame_id, label_idx, query_idx FROM bx JOIN {THRESHOLDS} USING (label_idx) WHERE score > threshold AND threshold_idx = 1")
def _(fx):
    th = fx.spark.sql("SELECT * FROM VALUES (0, 0, 0.50D), (0, 1, 0.52D), (1, 0, 0.51D), (1, 1, 0.53D), (2, 0, 0.50D), (3, 0, 0.52D) AS th(label_idx, threshold_idx, threshold)")
    return D.swept(scored(fx), th.where("threshold_idx = 1"), "label_idx").select("frame_id", "label_idx", "query_idx")


@query("o4_detection_order", recursive(BOX + nms_sql("bx", "frame_id, label_idx", "0.6e0", "n1") + " SELECT frame_id, query_idx, row_number() OVER (PARTITION BY frame_id ORDER BY round(score, 12) DESC, query_idx) AS nth FROM n1"))
def _(fx):
    order = Window.partitionBy("frame_id").orderBy(F.desc("score"), "query_idx")
    return same_label(fx).select("frame_id", "query_idx", F.row_number().over(order).alias("nth"))


@query("c4_window_cloud", DEPTH + f", ord AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings) SELECT vec_id, {POINTS} FROM dp WHERE z <= 12")
def _(fx):
    return R.depth_points(R.kept_pixels(raster(fx), cut_off=12.0), K8).select("vec_id", *rounded(x="x", y="y", z="z"))


# Each raster is the depth of one camera's frame: the sample by its number modulo the samples, the camera modulo six.
C4 = DEPTH + ", " + FRAMES.removeprefix("WITH ") + ", " + WIN.format(w=7, s=3, l=2).removeprefix("WITH ") + """,
us AS (SELECT fr.*, window_id, row_number() OVER (PARTITION BY token ORDER BY window_id) AS nth FROM fr JOIN wi USING (scene_token) WHERE sample_index >= used_start AND sample_index < used_end),
cam AS (SELECT vec_id, u, v, (u - 4.08e0) * z / 6.33e0 AS x, (v - 2.455e0) * z / 6.33e0 AS y, z, (vec_id % (SELECT count(*) FROM fx_sample)) * 10 + vec_id % 6 AS token FROM dp WHERE z <= 30 AND NOT sky),
c4 AS (SELECT * FROM cam JOIN us USING (token) WHERE nth = 1),
e AS (SELECT *, """ + rotate_sql("sq", ("x", "y", "z"), "r") + """ FROM c4),
g AS (SELECT *, """ + rotate_sql("eq", ("rx + stx", "ry + sty", "rz + stz"), "g") + """ FROM e)
SELECT scene_token, window_id, token, vec_id, u, v, round(gx + etx, 6) + 0e0 AS x, round(gy + ety, 6) + 0e0 AS y, round(gz + etz, 6) + 0e0 AS z FROM g"""


@query("c4_all_window_cloud", C4)
def _(fx):
    used = S.used_window(frames(fx), 7, 3)
    samples = F.broadcast(fx.sample.agg(F.count("*").alias("n_samples")))  # one row
    cloud = R.depth_points(R.kept_pixels(raster(fx), cut_off=30.0, sky=F.col("sky")), K8).crossJoin(samples)
    cloud = cloud.withColumn("token", (F.col("vec_id") % F.col("n_samples")) * 10 + F.col("vec_id") % 6)
    rows = cloud.select("vec_id", "u", "v", "x", "y", "z", "token").join(used.hint("merge"), "token")  # pixels are exploded rows
    rows = rows.withColumns(Q.apply(Pose(Quat.of("sq"), Vec.of("st")), Vec.of("")).named("r"))
    p = Q.apply(Pose(Quat.of("eq"), Vec.of("et")), Vec.of("r"))
    return rows.select("scene_token", "window_id", "token", "vec_id", "u", "v", *rounded(x=p.x, y=p.y, z=p.z))


@query("c6_cloud_comparison", DEPTH + "SELECT vec_id, source, count(*) AS n, round(avg(z), 6) AS z FROM (SELECT vec_id, 'pseudo' AS source, z FROM dp WHERE NOT sky UNION ALL SELECT vec_id, 'measured', z FROM dp WHERE mask) GROUP BY 1, 2")
def _(fx):
    a = R.kept_pixels(raster(fx), sky=F.col("sky")).select("vec_id", F.lit("pseudo").alias("source"), "z")
    b = R.kept_pixels(raster(fx), mask=F.col("mask")).select("vec_id", F.lit("measured").alias("source"), "z")
    return a.unionByName(b).groupBy("vec_id", "source").agg(F.count("*").alias("n"), r6(F.avg("z")).alias("z"))


@query("c7_coloured_cloud", DEPTH + "SELECT vec_id, u, v, round((u - 4e0) * z / 6.33e0, 6) + 0e0 AS x, round((u * 32 + v) / 255e0, 6) AS red FROM dp WHERE mask")
def _(fx):
    points = R.depth_points(R.kept_pixels(raster(fx), mask=F.col("mask")), (6.33, 6.33, 4.0, 4.0))
    return points.select("vec_id", "u", "v", r6("x").alias("x"), r6((F.col("u") * 32 + F.col("v")) / 255).alias("red"))


@query("m5_crop_truncation", "SELECT vec_id, CAST(trunc(CAST(embedding[1] AS DOUBLE) * 20) AS INTEGER) AS x0, CAST(trunc(CAST(embedding[2] AS DOUBLE) * 20) AS INTEGER) AS y0 FROM embeddings")
def _(fx):
    cut = lambda i: (F.col("embedding")[i].cast("double") * 20).cast("int")
    return fx.raw("embeddings").select("vec_id", cut(0).alias("x0"), cut(1).alias("y0"))


@query("u2_f18_clipped_points", BOXES + "SELECT channel, category_group, count(*) AS n FROM seen GROUP BY 1, 2")
def _(fx):
    return B.clipped_ends(seen_boxes(fx)).where("n_ends > 0").groupBy("channel", "category_group").agg(F.count("*").alias("n"))
