"""Frames as wholes: references, counts of every stage, window bundles, results found again, record checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as B
from ..operators import checks as C
from ..operators import scene as S
from .extra_queries import KEYS, rotate_sql
from .fixtures import K
from .raster_queries import PX
from .registry import nearest, query, rounded
from .scene_queries import BOX_KEYS, BOXES, F19_ALL, FRAMES, WIN, frames, seen_boxes, unrotate

GROUPS = ("vehicle", "road_object", "two_wheeler", "pedestrian")
GROUP_ROWS = "(VALUES " + ", ".join(f"('{g}')" for g in GROUPS) + ") AS g(category_group)"


@query("p1_scene_by_name", "WITH sc AS (SELECT DISTINCT scene_token AS token, 'scene-' || scene_token % 10 AS name FROM fx_sample) SELECT sample_token, scene_token, name FROM fx_sample JOIN (SELECT min(token) AS scene_token, name FROM sc WHERE name = 'scene-7' GROUP BY name) USING (scene_token)")
def _(fx):
    """Names repeat: the first scene of the name, and its samples."""
    scenes = fx.sample.select(F.col("scene_token").alias("token")).distinct().withColumn("name", F.concat(F.lit("scene-"), (F.col("token") % 10).cast("string")))
    one = S.scene_named(scenes, "scene-7").withColumnRenamed("token", "scene_token")
    return fx.sample.join(F.broadcast(one), "scene_token").select("sample_token", "scene_token", "name")  # one row


ORPHANS = """SELECT token, 'sample' AS missing, CAST(sample_token AS VARCHAR) AS key FROM fx_sample_data WHERE sample_token NOT IN (SELECT sample_token FROM fx_sample WHERE scene_token % 11 <> 4)
UNION ALL SELECT token, 'ego_pose', CAST(ego_pose_token AS VARCHAR) FROM fx_sample_data WHERE ego_pose_token NOT IN (SELECT token FROM fx_ego_pose WHERE tx >= 1)
UNION ALL SELECT token, 'calibrated_sensor', CAST(calibrated_sensor_token AS VARCHAR) FROM fx_sample_data WHERE calibrated_sensor_token NOT IN (SELECT sensor_id FROM fx_sensor WHERE tx > 0.5)"""


@query("j2_j3_orphans", ORPHANS)
def _(fx):
    """All records of sensors, against tables from which some samples, poses and sensors were taken."""
    return S.orphans(fx.sample_data, fx.sample.where("scene_token % 11 <> 4"), fx.ego_pose.where("tx >= 1"), fx.sensor.where("tx > 0.5"))


@query("a1_boxes_per_frame", BOXES + f", ct AS (SELECT token, category_group, count(*) AS n FROM seen GROUP BY 1, 2) SELECT fr.token, channel, category_group, coalesce(n, 0) AS n_boxes FROM fr CROSS JOIN {GROUP_ROWS} LEFT JOIN ct USING (token, category_group) WHERE channel LIKE 'CAM%'")
def _(fx):
    """Boxes in view of each frame, channel and group, also where there are none: counts side by side, then a row for each group."""
    counted = seen_boxes(fx).groupBy("token").agg(*(F.count_if(F.col("category_group") == g).alias(g) for g in GROUPS))
    rows = S.in_channels(frames(fx), S.CAMERAS).select("token", "channel").join(counted, "token", "left")
    groups = F.array(*(F.struct(F.lit(g).alias("category_group"), F.coalesce(g, F.lit(0)).alias("n_boxes")) for g in GROUPS))
    return rows.select("token", "channel", F.inline(groups))


STAGES = F19_ALL.rsplit("\nSELECT", 1)[0] + """, al AS (SELECT fr.token, count(*) AS n_all, count(c.category_name) AS n_mapped FROM fr JOIN fx_annotation a USING (sample_token) JOIN fx_category c USING (category_token) WHERE fr.channel LIKE 'CAM%' GROUP BY 1),
sn AS (SELECT token, count(*) AS n FROM seen GROUP BY 1), pj AS (SELECT token, count(*) AS n FROM ex WHERE x1 - x0 >= 1 AND y1 - y0 >= 1 GROUP BY 1)
SELECT token, n_all, n_mapped, coalesce(sn.n, 0) AS n_in_view, coalesce(pj.n, 0) AS n_projected FROM al LEFT JOIN sn USING (token) LEFT JOIN pj USING (token)"""


@query("a2_counts_of_stages", STAGES)
def _(fx):
    """Of each camera's frame: all annotations of its sample, those with a class, in view, and with a box in the image."""
    rows = B.box_stages(S.in_channels(frames(fx), S.CAMERAS), fx.annotation, fx.category, K)
    return rows.groupBy("token").agg(F.count("*").alias("n_all"), *(F.count_if(c).alias(f"n_{c}") for c in ("mapped", "in_view", "projected")))


STACKED = FRAMES + ", " + WIN.format(w=7, s=3, l=2).removeprefix("WITH ") + """,
bn AS (SELECT fr.*, window_id, row_number() OVER (PARTITION BY scene_token, channel, window_id ORDER BY sample_index) - 1 AS nth, sqrt((sqw*sqw + sqx*sqx + sqy*sqy + sqz*sqz) * (eqw*eqw + eqz*eqz)) AS n, token % 10 AS camera,
  eqw*sqw - eqz*sqz AS pw, eqw*sqx - eqz*sqy AS px_, eqw*sqy + eqz*sqx AS py_, eqw*sqz + eqz*sqw AS pz_ FROM fr JOIN wi USING (scene_token) WHERE sample_index >= window_start AND sample_index < window_end AND channel LIKE 'CAM%'),
ps AS (SELECT *, """ + rotate_sql("eq", ("stx", "sty", "stz"), "c") + """ FROM bn),
iv AS (SELECT *, pw AS gqw, px_ AS gqx, py_ AS gqy, pz_ AS gqz, cx + etx AS gx, cy + ety AS gy, cz + etz AS gz FROM ps),
al AS (SELECT *, """ + unrotate("gq", ("-gx", "-gy", "-gz"), "i") + """ FROM iv)
SELECT scene_token, channel, window_id, nth, token AS image, 1266e0 + camera AS fx, 816e0 - camera AS cx, round(pw / n, 6) + 0e0 AS qw, round(px_ / n, 6) + 0e0 AS qx, round(py_ / n, 6) + 0e0 AS qy, round(pz_ / n, 6) + 0e0 AS qz,
  round(gx, 6) + 0e0 AS tx, round(gy, 6) + 0e0 AS ty, round(gz, 6) + 0e0 AS tz, round(ix, 6) + 0e0 AS inv_tx, round(iy, 6) + 0e0 AS inv_ty, round(iz, 6) + 0e0 AS inv_tz FROM al"""


@query("a13_window_bundles", STACKED)
def _(fx):
    """Each camera's windows as stacks of images, intrinsics, poses to the global frame and their inverses; shown a row for each place."""
    rows = S.in_channels(frames(fx), S.CAMERAS)
    camera = (F.col("_0") % 10).cast("double")
    k = F.array(F.array(1266.0 + camera, F.lit(0.0), 816.0 - camera), F.array(F.lit(0.0), 1266.0 + camera, F.lit(491.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    made = {"images": F.col("_0"), "intrinsics": k, **S.made_poses()}
    stacks = S.stacked_windows(rows, ["scene_token", "channel"], ["token"], S.moved_pose(), made, 7, 3, arrived=S.arrived_pose)
    parts = [F.col(f"rows.{name}").alias(name) for name in made]
    stacks = stacks.select("scene_token", "channel", "window_id", *parts)
    shown = stacks.select("scene_token", "channel", "window_id", F.posexplode(F.arrays_zip(*made)).alias("nth", "x"))
    return shown.select("scene_token", "channel", "window_id", "nth", F.col("x.images").alias("image"), F.col("x.intrinsics")[0][0].alias("fx"), F.col("x.intrinsics")[0][2].alias("cx"), *rounded(**{c: f"x.to_global.{c}" for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")}, **{f"inv_{c}": f"x.from_global.{c}" for c in ("tx", "ty", "tz")}))


#: Boxes turned and moving in all directions, in ego frames that are turned about all axes too.
TURNED = """(SELECT * EXCLUDE (qx, qy), 0e0 + l_partkey % 3 AS qx, 0e0 + l_suppkey % 2 AS qy, l_orderkey % 5 - 2e0 AS vz FROM fx_annotation)"""
TILTED = "(SELECT * EXCLUDE (qx, qy), 0e0 + token % 3 AS qx, 0e0 + token % 2 AS qy FROM fx_ego_pose)"
TURN = BOXES.replace("fx_ego_pose e", TILTED + " e").replace("FROM fx_annotation a", f"FROM {TURNED} a").split(",\nca AS")[0]


@query("f14_turned_boxes_in_ego", TURN + f", vl AS (SELECT *, {unrotate('eq', ('vx', 'vy', 'vz'), 'w')}, sqrt((eqw*eqw + eqx*eqx + eqy*eqy + eqz*eqz) * (qw*qw + qx*qx + qy*qy + qz*qz)) AS n FROM eg) SELECT token, {KEYS}, label, round(kx, 5) + 0e0 AS bx, round(ky, 5) + 0e0 AS by_, round(kz, 5) + 0e0 AS bz, round((eqw*qw + eqx*qx + eqy*qy + eqz*qz) / n, 6) + 0e0 AS bqw, round((eqw*qx - eqx*qw - eqy*qz + eqz*qy) / n, 6) + 0e0 AS bqx, round((eqw*qy + eqx*qz - eqy*qw - eqz*qx) / n, 6) + 0e0 AS bqy, round((eqw*qz - eqx*qy + eqy*qx - eqz*qw) / n, 6) + 0e0 AS bqz, round(wx, 6) + 0e0 AS bvx, round(wy, 6) + 0e0 AS bvy, round(wz, 6) + 0e0 AS bvz FROM vl")
def _(fx):
    """Centre, all parts of the rotation, and three-dimensional velocity."""
    tilt = lambda rows, x, y: rows.withColumns({"qx": x.cast("double"), "qy": y.cast("double")})
    boxes = tilt(fx.annotation, F.col("l_partkey") % 3, F.col("l_suppkey") % 2).withColumn("vz", (F.col("l_orderkey") % 5 - 2).cast("double"))
    rows = S.frames(fx.sample_data, fx.sample, tilt(fx.ego_pose, F.col("token") % 3, F.col("token") % 2), fx.sensor)
    out = B.to_ego(B.frame_boxes(S.in_channels(rows, S.CAMERAS), B.labelled(boxes, fx.category)))
    return out.select(*BOX_KEYS, "label", *((nearest(c, 5) + 0.0).alias(n) for n, c in (("bx", "bx"), ("by_", "by"), ("bz", "bz"))), *rounded(bqw="bqw", bqx="bqx", bqy="bqy", bqz="bqz", bvx="bvx", bvy="bvy", bvz="bvz"))


@query("s1_box_checks", "WITH b AS (SELECT frame_id, query_idx, CASE WHEN query_idx % 7 = 3 THEN NULL ELSE cx END AS x0, cy AS y0, CASE WHEN query_idx % 5 = 1 THEN CAST('inf' AS DOUBLE) ELSE cx + w END AS x1, CASE WHEN query_idx % 11 = 2 THEN CAST('nan' AS DOUBLE) ELSE cy + h END AS y1 FROM fx_detection) SELECT frame_id, query_idx, CASE WHEN x0 IS NULL OR NOT isfinite(x0) OR NOT isfinite(y0) OR NOT isfinite(x1) OR NOT isfinite(y1) THEN 'a box has four finite coordinates' ELSE 'good' END AS verdict FROM b")
def _(fx):
    """Boxes with planted faults: a missing corner, infinite and undefined ones."""
    q = F.col("query_idx")
    rows = fx.detection.select("frame_id", "query_idx", F.when(q % 7 != 3, F.col("cx")).alias("x0"), F.col("cy").alias("y0"), F.when(q % 5 == 1, float("inf")).otherwise(F.col("cx") + F.col("w")).alias("x1"), F.when(q % 11 == 2, float("nan")).otherwise(F.col("cy") + F.col("h")).alias("y1"))
    good, bad = C.split(rows, C.box_problems(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))
    return good.select("frame_id", "query_idx", F.lit("good").alias("verdict")).unionByName(bad.select("frame_id", "query_idx", F.array_join("reasons", "; ").alias("verdict")))


@query("s1_instance_checks", PX + """, rg AS (SELECT vec_id, min(u) AS x0, min(v) AS y0, max(u) + 1 AS x1, max(v) + 1 AS y1 FROM px WHERE e > 0.1e0 GROUP BY 1),
f AS (SELECT vec_id, x1 - x0 - CASE WHEN vec_id % 6 = 1 THEN 1 ELSE 0 END AS w, y1 - y0 AS h, (x1 - x0) * (y1 - y0) - CASE WHEN vec_id % 5 = 2 THEN 1 ELSE 0 END AS n, vec_id % 7 <> 3 AS has_mask, vec_id % 9 <> 4 AS has_region,
  CASE WHEN vec_id % 8 = 5 THEN 0 ELSE x1 - x0 END AS rw, y1 - y0 AS rh FROM rg)
SELECT vec_id, concat_ws('; ', CASE WHEN has_mask <> has_region THEN 'mask and region come together' END, CASE WHEN has_mask AND has_region AND rw <= 0 THEN 'a region ends behind its start' END,
  CASE WHEN has_mask AND has_region AND (w <> rw OR h <> rh) THEN 'a mask has its region''s width and height' END, CASE WHEN has_mask AND n <> w * h THEN 'a mask has a bit for each pixel' END) AS reasons FROM f""")
def _(fx):
    """Instances with planted faults of each kind, and what they break; good ones break nothing."""
    from ..operators import raster as R

    rows = fx.raw("embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("scores"))
    found = R.mask_instances(rows, "scores", F.lit(8), F.lit(8), 0.1)
    k = F.col("vec_id")
    wide, high = F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0")
    mask = F.when(k % 7 != 3, F.when(k % 5 == 2, F.slice("mask", F.lit(1), F.size("mask") - 1)).otherwise(F.col("mask")))
    region = F.when(k % 9 != 4, F.struct(F.col("rx0").alias("x0"), F.col("ry0").alias("y0"), F.when(k % 8 == 5, F.col("rx0")).otherwise(F.col("rx1")).alias("x1"), F.col("ry1").alias("y1")))
    rows = found.select("vec_id", mask.alias("mask"), F.when(k % 6 == 1, wide - 1).otherwise(wide).alias("w"), high.alias("h"), region.alias("region"))
    held = C.checked(rows, C.instance_problems(F.col("mask"), F.col("w"), F.col("h"), F.col("region")))
    return held.select("vec_id", F.array_join("reasons", "; ").alias("reasons"))
