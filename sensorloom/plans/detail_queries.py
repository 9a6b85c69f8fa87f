"""Queries that hold whole results of operators against their twins: matrices, masks as instances, crops, comparisons, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pose as Q
from ..functions.pose import Pose, Quat, Vec
from ..operators import boxes as B
from ..operators import detect as D
from ..operators import raster as R
from ..operators import scene as S
from .extra_queries import ANN, KEYS, rotate_sql
from .fixtures import K
from .raster_queries import BOX, DEPTH, K8, MASK, SCORES, mask, raster, scored
from .registry import nearest, query, r6, rounded
from .scene_queries import BOX_KEYS, BOXES, EDGE_ROWS, FRAMES, ROT_ALL, W2, ego_boxes, frames, seen_boxes, tracked


@query("p9_drop_unmapped", "SELECT c.category_name AS label, c.category_group, count(*) AS n FROM fx_annotation a JOIN fx_category c USING (category_token) WHERE c.category_name IS NOT NULL GROUP BY 1, 2")
def _(fx):
    return B.labelled(fx.annotation, fx.category).groupBy("label", "category_group").agg(F.count("*").alias("n"))


@query("f4_whole_rotation_matrix", """WITH q AS (SELECT token, qw / n AS w, qx / n AS x, qy / n AS y, qz / n AS z FROM (SELECT *, sqrt(qw*qw + qx*qx + qy*qy + qz*qz) AS n FROM (
  SELECT token, eqw*sqw - eqz*sqz AS qw, eqw*sqx - eqz*sqy AS qx, eqw*sqy + eqz*sqx AS qy, eqw*sqz + eqz*sqw AS qz FROM (""" + FRAMES + """SELECT * FROM fr))))
SELECT token, round(w*w + x*x - y*y - z*z, 6) + 0e0 AS m00, round(2*(x*y - w*z), 6) + 0e0 AS m01, round(2*(x*z + w*y), 6) + 0e0 AS m02,
  round(2*(x*y + w*z), 6) + 0e0 AS m10, round(w*w - x*x + y*y - z*z, 6) + 0e0 AS m11, round(2*(y*z - w*x), 6) + 0e0 AS m12,
  round(2*(x*z - w*y), 6) + 0e0 AS m20, round(2*(y*z + w*x), 6) + 0e0 AS m21, round(w*w - x*x - y*y + z*z, 6) + 0e0 AS m22 FROM q""")
def _(fx):
    """Of each frame's sensor in the global frame: rotations about all axes."""
    m = Q.matrix(Q.multiply(Quat.of("eq"), Quat.of("sq")))
    return frames(fx).select("token", *rounded(**{f"m{i}{j}": c for i, row in enumerate(m) for j, c in enumerate(row)}))


@query("f12_whole_pose", "WITH f AS (" + FRAMES + "SELECT *, sqrt(sqw*sqw + sqx*sqx + sqy*sqy + sqz*sqz) * sqrt(eqw*eqw + eqz*eqz) AS n, " + rotate_sql("eq", ("stx", "sty", "stz"), "c") + " FROM fr) SELECT token, round(cx + etx, 6) + 0e0 AS tx, round(cy + ety, 6) + 0e0 AS ty, round(cz + etz, 6) + 0e0 AS tz, round((eqw*sqw - eqz*sqz) / n, 6) + 0e0 AS qw, round((eqw*sqx - eqz*sqy) / n, 6) + 0e0 AS qx, round((eqw*sqy + eqz*sqx) / n, 6) + 0e0 AS qy, round((eqw*sqz + eqz*sqw) / n, 6) + 0e0 AS qz FROM f")
def _(fx):
    both = Q.compose(Pose(Quat.of("eq"), Vec.of("et")), Pose(Quat.of("sq"), Vec.of("st")))
    return frames(fx).select("token", *rounded(tx=both.t.x, ty=both.t.y, tz=both.t.z, qw=both.q.w, qx=both.q.x, qy=both.q.y, qz=both.q.z))


@query("f13_camera_matrices", BOXES + f"SELECT token, {KEYS}, round(((1266e0 + 10 * (token % 10)) * px + 2.5e0 * py + 816e0 * pz) / pz + 2e-4, 3) AS u, round(((1266e0 - 5 * (token % 10)) * py + 491e0 * pz) / pz + 2e-4, 3) AS v FROM ca WHERE round(pz, 6) > 0.1")
def _(fx):
    """Each camera has its own 3 x 3 matrix, with skew."""
    camera = F.col("token") % 10
    row = lambda *c: F.array(*(x if not isinstance(x, float) else F.lit(x) for x in c))
    k = F.array(row(1266.0 + 10.0 * camera, 2.5, 816.0), row(0.0, 1266.0 - 5.0 * camera, 491.0), row(0.0, 0.0, 1.0))
    rows = B.to_camera(ego_boxes(fx), Vec.of("b")).where("round(pz, 6) > 0.1D").withColumn("k", k)
    u, v = Q.project_matrix(Vec.of("p"), F.col("k"))
    return rows.select(*BOX_KEYS, F.round(u + 2e-4, 3).alias("u"), F.round(v + 2e-4, 3).alias("v"))


@query("p22_finite_projections", DEPTH + "SELECT vec_id, bool_and(floor(e * 4) <> 0) AS finite, count(*) FILTER (WHERE floor(e * 4) <> 0) AS n_finite FROM dp GROUP BY 1")
def _(fx):
    """Points at a depth of zero have no pixel."""
    rows = raster(fx).withColumn("z", F.floor(F.col("e") * 4).cast("double"))
    k = F.array(*(F.array(*(F.lit(x) for x in r)) for r in ((K[0], 0.0, K[2]), (0.0, K[1], K[3]), (0.0, 0.0, 1.0))))
    u, v = Q.project_matrix(Vec(F.col("u").cast("double"), F.col("v").cast("double"), F.col("z")), k)
    return rows.withColumn("ok", Q.finite(u, v)).groupBy("vec_id").agg(F.bool_and("ok").alias("finite"), F.count_if("ok").alias("n_finite"))


SEGMENT = "SELECT *, (0.05e0 - a2) / nullif(b2 - a2, 0) AS t FROM (SELECT vec_id, " + ", ".join(f"CAST(embedding[{3 * k + i + 1}] AS DOUBLE) AS {a}{i}" for k, a in enumerate("ab") for i in range(3)) + " FROM embeddings)"


@query("f17_whole_segment", "SELECT vec_id, " + ", ".join(f"round(CASE WHEN {a}2 >= 0.05e0 THEN {a}{i} ELSE a{i} + t * (b{i} - a{i}) END, 6) + 0e0 AS {o}{n}" for a, o in (("a", "p"), ("b", "q")) for i, n in enumerate("xyz")) + f" FROM ({SEGMENT}) WHERE a2 >= 0.05e0 OR b2 >= 0.05e0")
def _(fx):
    e = lambda i: F.col("embedding")[i].cast("double")
    a, b = (F.struct(e(i).alias("x"), e(i + 1).alias("y"), e(i + 2).alias("z")) for i in (0, 3))
    p, q, there = B.clip_near(a, b, 0.05)
    return fx.raw("embeddings").where(there).select("vec_id", *rounded(**{o + n: end[n] for o, end in (("p", p), ("q", q)) for n in "xyz"}))


CLIPPED = BOXES + ROT_ALL + f""", eg2 AS (SELECT a.token, a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.wx AS ax, a.wy AS ay, a.wz AS az, b.wx AS bx, b.wy AS by_, b.wz AS bz FROM {EDGE_ROWS} JOIN cc a ON a.i = k.i JOIN cc b ON b.i = k.j AND (a.token, a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey) = (b.token, b.l_orderkey, b.l_linenumber, b.l_partkey, b.l_suppkey) WHERE a.wz >= 0.1 OR b.wz >= 0.1),
en AS (SELECT token, {KEYS}, CASE WHEN az >= 0.1 THEN ax ELSE ax + (0.1 - az) / (bz - az) * (bx - ax) END AS x, CASE WHEN az >= 0.1 THEN ay ELSE ay + (0.1 - az) / (bz - az) * (by_ - ay) END AS y, greatest(az, 0.1) AS z FROM eg2
  UNION ALL SELECT token, {KEYS}, CASE WHEN bz >= 0.1 THEN bx ELSE ax + (0.1 - az) / (bz - az) * (bx - ax) END, CASE WHEN bz >= 0.1 THEN by_ ELSE ay + (0.1 - az) / (bz - az) * (by_ - ay) END, greatest(bz, 0.1) FROM eg2)
SELECT token, {KEYS}, count(*) AS n, round(avg(x), 4) + 0e0 AS x, round(avg(y), 4) + 0e0 AS y, round(avg(z), 4) + 0e0 AS z FROM en GROUP BY ALL"""


@query("u2_f18_clipped_box_points", CLIPPED)
def _(fx):
    """How many ends the clipped edges of each box have, and their mean."""
    rows = B.clipped_ends(seen_boxes(fx)).where("n_ends > 0")
    return rows.select(*BOX_KEYS, F.col("n_ends").alias("n"), *((nearest("end_" + n, 4) + 0.0).alias(n) for n in "xyz"))


@query("f21_global_boxes", FRAMES + ", " + W2.removeprefix("WITH ").split("),\n", 1)[1] + ", an AS (SELECT a.*, c.category_name AS label FROM fx_annotation a JOIN fx_category c USING (category_token) WHERE c.category_name IS NOT NULL) SELECT fr.token, l_orderkey, l_linenumber, l_partkey, l_suppkey, label, tracking_id, cx, cy, cz, round(sl, 6) AS length, round(sw, 6) AS width_m, round(sh, 6) AS height_m FROM fr JOIN an USING (sample_token) JOIN tr ON tr.scene_token = fr.scene_token AND tr.instance_token = an.instance_token WHERE fr.channel LIKE 'CAM%'")
def _(fx):
    ids = S.sample_tracking_ids(tracked(fx)[0], "scene_token", "instance_token", ["sample_index", "l_orderkey"])
    rows = B.global_boxes(S.in_channels(frames(fx), S.CAMERAS), B.labelled(fx.annotation, fx.category), ids)
    return rows.select(*BOX_KEYS, "label", "tracking_id", "cx", "cy", "cz", *(nearest(c, 6).alias(c) for c in ("length", "width_m", "height_m")))


@query("a4_first_seen_order", "WITH si AS (SELECT *, row_number() OVER (PARTITION BY scene_token ORDER BY sample_ts, sample_token) - 1 AS sample_index FROM fx_sample), f AS (SELECT scene_token, category_token, min(sample_index * 100000000 + l_orderkey) AS k FROM fx_annotation JOIN si USING (sample_token) GROUP BY 1, 2) SELECT scene_token, category_token, row_number() OVER (PARTITION BY scene_token ORDER BY k, category_token) - 1 AS nth FROM f")
def _(fx):
    rows = fx.annotation.join(S.with_sample_index(fx.sample), "sample_token")
    return S.first_seen(rows, ["scene_token"], "category_token", ["sample_index", "l_orderkey"])


POLYGON = "WITH pt AS (SELECT vec_id, CAST(i AS INTEGER) AS i, round(CAST(embedding[2 * i + 1] AS DOUBLE), {d}) AS x, round(CAST(embedding[2 * i + 2] AS DOUBLE), {d}) AS y FROM embeddings, LATERAL (SELECT unnest(generate_series(0, 31)) AS i))"


def polygon(fx, decimals):
    """The components as 32 points (x, y)."""
    at = lambda i: F.round(F.element_at("embedding", i).cast("double"), decimals)
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(at(2 * i + 1).alias("x"), at(2 * i + 2).alias("y")))
    return fx.raw("embeddings").select("vec_id", points.alias("points"))


@query("a9_polygon_extent", POLYGON.format(d=6) + " SELECT vec_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pt GROUP BY 1")
def _(fx):
    return polygon(fx, 6).select("vec_id", *(c.alias(n) for n, c in B.polygon_extent(F.col("points")).items()))


@query("a10_first_of_near_points", POLYGON.format(d=12) + ", k AS (SELECT *, floor(x * 8) AS gx, floor(y * 8) AS gy FROM pt), f AS (SELECT vec_id, min(i) AS i, gx, gy FROM k GROUP BY vec_id, gx, gy) SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS INTEGER) AS nth, CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy FROM f")
def _(fx):
    """Cells of an eighth, with noise in the twelfth decimal: what ten decimals tell apart, in the order of the first of each."""
    rows = polygon(fx, 12)
    cells = F.transform("points", lambda p, i: F.struct((F.floor(p["x"] * 8).cast("double") + i * 1e-13).alias("x"), F.floor(p["y"] * 8).cast("double").alias("y")))
    kept = B.distinct_points(F.col("cells"), ("x", "y"))
    rows = rows.select("vec_id", cells.alias("cells")).select("vec_id", F.posexplode(kept).alias("nth", "p"))
    return rows.select("vec_id", "nth", F.round("p.x").cast("long").alias("gx"), F.round("p.y").cast("long").alias("gy"))


@query("a15_group_index", SCORES + ", g AS (SELECT frame_id, query_idx, CASE WHEN label_idx < 2 THEN 'vehicle' ELSE '__label__:' || label_idx END AS nms_group FROM bl), f AS (SELECT frame_id, nms_group, row_number() OVER (PARTITION BY frame_id ORDER BY min(query_idx)) - 1 AS nms_index FROM g GROUP BY 1, 2) SELECT frame_id, query_idx, nms_group, nms_index FROM g JOIN f USING (frame_id, nms_group)")
def _(fx):
    best = D.best_label(D.label_scores(fx.detection, _spans(fx), ["frame_id", "query_idx"]), ["frame_id", "query_idx"])
    rows = best.withColumn("nms_group", D.exclusive_group(F.col("label_idx"), {"0": "vehicle", "1": "vehicle"}))
    return D.group_index(rows, ["frame_id"], "nms_group", ["query_idx"]).select("frame_id", "query_idx", "nms_group", "nms_index")


def _spans(fx):
    from .raster_queries import spans

    return spans(fx)


@query("p24_whole_pixel_boxes", BOX + "SELECT frame_id, query_idx, round(x0 * 1600, 4) AS x0, round(y0 * 900, 4) AS y0, round(x1 * 1600, 4) AS x1, round(y1 * 900, 4) AS y1 FROM bx")
def _(fx):
    box = B.box_to_original(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), (1600, 900))
    return scored(fx).select("frame_id", "query_idx", *(F.round(c, 4).alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), box, strict=True)))


@query("f24_normalized_box_to_original", BOX + "SELECT frame_id, query_idx, round(x0 * 400 + 10, 4) AS x0, round(y0 * 300 + 20, 4) AS y0, round(x1 * 400 + 10, 4) AS x1, round(y1 * 300 + 20, 4) AS y1 FROM bx")
def _(fx):
    """Boxes in parts of a 640 x 480 input, itself a resized crop of 400 x 300: the input's size cancels out."""
    box = B.box_to_original(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), (1600, 900), (10, 20, 410, 320), (640, 480))
    return scored(fx).select("frame_id", "query_idx", *(F.round(c, 4).alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), box, strict=True)))


@query("a11_whole_voxels", DEPTH + ", pt AS (SELECT vec_id, (u - 4.08e0) * z / 6.33e0 AS x, (v - 2.455e0) * z / 6.33e0 AS y, z FROM dp), lo AS (SELECT vec_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pt GROUP BY 1) SELECT vec_id, CAST(floor((x - lx + 2) / 4) AS BIGINT) AS ix, CAST(floor((y - ly + 2) / 4) AS BIGINT) AS iy, CAST(floor((z - lz + 2) / 4) AS BIGINT) AS iz, count(*) AS n_points, round(avg(x), 6) + 0e0 AS x, round(avg(y), 6) + 0e0 AS y, round(avg(z), 6) + 0e0 AS z FROM pt JOIN lo USING (vec_id) GROUP BY 1, 2, 3, 4")
def _(fx):
    cloud = R.depth_points(raster(fx), K8).select("vec_id", "x", "y", "z")
    return R.voxels(cloud, 4.0, ["vec_id"]).select("vec_id", "ix", "iy", "iz", "n_points", *rounded(x="x", y="y", z="z"))


@query("c6_voxelized_comparison", DEPTH + ", pt AS (SELECT vec_id, 'pseudo' AS source, (u - 4.08e0) * z / 6.33e0 AS x, (v - 2.455e0) * z / 6.33e0 AS y, z FROM dp WHERE NOT sky UNION ALL SELECT vec_id, 'measured', (u - 4.08e0) * z / 6.33e0, (v - 2.455e0) * z / 6.33e0, z FROM dp WHERE mask), lo AS (SELECT vec_id, source, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pt GROUP BY 1, 2), vx AS (SELECT vec_id, source, count(*) AS n, avg(z) AS z FROM pt JOIN lo USING (vec_id, source) GROUP BY vec_id, source, floor((x - lx + 4) / 8), floor((y - ly + 4) / 8), floor((z - lz + 4) / 8)) SELECT vec_id, source, count(*) AS n_cells, CAST(max(n) AS BIGINT) AS most, round(avg(z), 6) AS z FROM vx GROUP BY 1, 2")
def _(fx):
    points = R.depth_points(raster(fx), K8)
    cells = R.compared_clouds(R.kept_pixels(points, sky=F.col("sky")), R.kept_pixels(points, mask=F.col("mask")), ["vec_id"], 8.0)
    return cells.groupBy("vec_id", "source").agg(F.count("*").alias("n_cells"), F.max("n_points").alias("most"), r6(F.avg("z")).alias("z"))


@query("c7_rgb_cloud", "WITH px AS (SELECT vec_id, CAST(p AS INTEGER) // 8 AS v, CAST(p AS INTEGER) % 8 AS u, 5e0 + 100e0 * abs(CAST(embedding[p + 1] AS DOUBLE)) AS z, CAST(floor(abs(CAST(embedding[64 - p] AS DOUBLE)) * 1000) AS BIGINT) AS c FROM embeddings, LATERAL (SELECT unnest(generate_series(0, 63)) AS p)) SELECT vec_id, u, v, round((u - 4) * z / 6.33e0, 6) + 0e0 AS x, round((v - 4) * z / 6.33e0, 6) + 0e0 AS y, round((c % 256) / 255e0, 6) AS red, round((c * 7 % 256) / 255e0, 6) AS green, round((c * 13 % 256) / 255e0, 6) AS blue FROM px")
def _(fx):
    """The colour raster is read from the components in reverse."""
    c = lambda e: F.floor(F.abs(e.cast("double")) * 1000)
    colours = F.transform(F.reverse("embedding"), lambda e: F.struct((c(e) % 256).alias("r"), (c(e) * 7 % 256).alias("g"), (c(e) * 13 % 256).alias("b")))
    rows = fx.raw("embeddings").select("vec_id", F.transform("embedding", lambda e: 5.0 + 100.0 * F.abs(e.cast("double"))).alias("depth"), colours.alias("rgb"))
    points = R.coloured_points(rows, "depth", "rgb", 8, 8, (6.33, 6.33), ["vec_id"])
    return points.select("vec_id", "u", "v", *rounded(x="x", y="y", red="red", green="green", blue="blue"))


@query("j19_list_of_masks", DEPTH + ", m AS (SELECT vec_id, 0 AS mask_id, u, v FROM px WHERE e > 0 UNION ALL SELECT vec_id, 1, u, v FROM px WHERE e > -0.1e0 AND u < 5) SELECT vec_id, mask_id, count(*) AS n, round(sum(z), 6) AS z FROM dp JOIN m USING (vec_id, u, v) WHERE z <= 25 GROUP BY 1, 2")
def _(fx):
    rows = raster(fx)
    masks = rows.where("e > 0").select("vec_id", F.lit(0).alias("mask_id"), "u", "v").unionByName(rows.where("e > -0.1D AND u < 5").select("vec_id", F.lit(1).alias("mask_id"), "u", "v"))
    both = R.in_masks(R.kept_pixels(rows, cut_off=25.0), masks, ["vec_id"])
    return both.groupBy("vec_id", "mask_id").agg(F.count("*").alias("n"), F.round(F.sum("z"), 6).alias("z"))


#: Kernel offsets by side, from the ellipse's equation.
KERNELS = "kn AS (SELECT k, du, dv FROM (SELECT unnest(generate_series(1, 9)) AS k), LATERAL (SELECT unnest(generate_series(-4, 4)) AS dv), LATERAL (SELECT unnest(generate_series(-4, 4)) AS du) WHERE dv BETWEEN -(k // 2) AND k - k // 2 - 1 AND du BETWEEN -(k // 2) AND k - k // 2 - 1 AND (k = 1 OR abs(du) <= round_even((k // 2) * sqrt(1 - (dv * dv) / ((k // 2) * (k // 2) * 1e0)), 0)))"
GRID = "gd AS (SELECT CAST(p AS INTEGER) % 8 AS u, CAST(p AS INTEGER) // 8 AS v FROM (SELECT unnest(generate_series(0, 63)) AS p))"


def dilate_sql(source: str, size: str, out: str) -> str:
    return f", {out} AS (SELECT DISTINCT m.vec_id, g.u, g.v FROM {source} m JOIN kn ON kn.k = {size} JOIN gd g ON g.u = m.u - kn.du AND g.v = m.v - kn.dv)"


def erode_sql(source: str, size: str, out: str) -> str:
    """Pixels whose true kernel pixels are as many as the kernel has inside the image."""
    return f""", {out}_n AS (SELECT k, g.u, g.v, count(*) AS n FROM kn, gd g WHERE g.u + du BETWEEN 0 AND 7 AND g.v + dv BETWEEN 0 AND 7 GROUP BY 1, 2, 3),
{out} AS (SELECT m.vec_id, h.u, h.v FROM {source} m JOIN kn ON kn.k = {size} JOIN {out}_n h ON h.k = kn.k AND h.u = m.u - kn.du AND h.v = m.v - kn.dv GROUP BY m.vec_id, h.u, h.v, h.n HAVING count(*) = h.n)"""


def true_pixels(fx, column):
    rows = fx.raw("embeddings").select("vec_id", column.alias("bits"))
    return R.pixels(rows, "bits", 8, ["vec_id"], "bit").where("bit").select("vec_id", "u", "v")


@query("m3_morphology_list", MASK + ", " + KERNELS + ", " + GRID + dilate_sql("mk", "3", "d1") + erode_sql("d1", "5", "e1") + dilate_sql("e1", "4", "d2") + " SELECT vec_id, u, v FROM d2")
def _(fx):
    """Dilated by 3, left alone, eroded by 5, dilated by 4."""
    bits = F.transform("embedding", lambda e: e.cast("double") > 0.1)
    return true_pixels(fx, R.morphology(bits, F.lit(8), F.lit(8), [3, 0, -5, 4]))


@query("m3_ratio_morphology", MASK + ", " + KERNELS + ", " + GRID + ", sd AS (SELECT vec_id, (max(u) - min(u) + max(v) - min(v) + 2) / 2e0 AS side FROM mk GROUP BY 1), ms AS (SELECT mk.*, CAST(ceil(0.6e0 * side) AS BIGINT) AS ka, CAST(ceil(0.35e0 * side) AS BIGINT) AS kb FROM mk JOIN sd USING (vec_id))" + dilate_sql("ms", "m.ka", "d1") + ", ds AS (SELECT d1.*, CAST(ceil(0.35e0 * side) AS BIGINT) AS kb FROM d1 JOIN sd USING (vec_id))" + erode_sql("ds", "m.kb", "e1") + " SELECT vec_id, u, v FROM e1")
def _(fx):
    """Sizes in parts of the mask's mean side."""
    bits = F.transform("embedding", lambda e: e.cast("double") > 0.1)
    return true_pixels(fx, R.morphology(bits, F.lit(8), F.lit(8), [0.6, -0.35], ratio=True))


@query("c3_morphology_pseudo_lidar", DEPTH + ", mk AS (SELECT vec_id, u, v FROM px WHERE e > 0.1e0), " + KERNELS + ", " + GRID + dilate_sql("mk", "3", "d1") + " SELECT vec_id, u, v, round((u - 4.08e0) * z / 6.33e0, 6) + 0e0 AS x, round((v - 2.455e0) * z / 6.33e0, 6) + 0e0 AS y, round(z, 6) AS z FROM dp JOIN d1 USING (vec_id, u, v) WHERE NOT sky AND z <= 30")
def _(fx):
    """The mask is dilated before it filters; sky and far pixels go in the same pass."""
    bits = R.morphology(F.transform("embedding", lambda e: e.cast("double") > 0.1), F.lit(8), F.lit(8), [3])
    rows = fx.raw("embeddings").select("vec_id", F.arrays_zip(F.transform("embedding", lambda e: e.cast("double")).alias("e"), bits.alias("bit")).alias("both"))
    pixels = R.pixels(rows, "both", 8, ["vec_id"], "d").select("vec_id", "u", "v", F.col("d.e").alias("e"), F.col("d.bit").alias("bit"))
    pixels = pixels.withColumns({"z": 5.0 + 100.0 * F.abs("e"), "sky": F.col("e") < -0.2})
    points = R.depth_points(R.kept_pixels(pixels, 30.0, F.col("bit"), F.col("sky")), K8)
    return points.select("vec_id", "u", "v", *rounded(x="x", y="y", z="z"))


INSTANCE = "WITH px AS (SELECT vec_id, CAST(p AS INTEGER) // 8 AS v, CAST(p AS INTEGER) % 8 AS u, CAST(embedding[p + 1] AS DOUBLE) AS e FROM embeddings, LATERAL (SELECT unnest(generate_series(0, 63)) AS p)), rg AS (SELECT vec_id, min(u) AS rx0, min(v) AS ry0, max(u) + 1 AS rx1, max(v) + 1 AS ry1 FROM px WHERE e > 0.15e0 GROUP BY 1)"


@query("m4_whole_instances", INSTANCE + " SELECT vec_id, rx0, ry0, rx1, ry1, string_agg(CAST(CAST(e > 0.15e0 AS INTEGER) AS VARCHAR), '' ORDER BY v, u) AS mask, CASE WHEN vec_id % 2 = 0 THEN rx0 ELSE 1e0 END AS x0, CASE WHEN vec_id % 2 = 0 THEN ry1 ELSE 7e0 END AS y1 FROM px JOIN rg USING (vec_id) WHERE u >= rx0 AND u < rx1 AND v >= ry0 AND v < ry1 GROUP BY vec_id, rx0, ry0, rx1, ry1")
def _(fx):
    """Rasters as mask scores; every other one has a prompt box of its own."""
    rows = fx.raw("embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("scores"))
    own = F.col("vec_id") % 2 == 1
    box = tuple(F.when(own, F.lit(c)).otherwise(F.col(r).cast("double")) for c, r in ((1.0, "rx0"), (2.0, "ry0"), (6.0, "rx1"), (7.0, "ry1")))
    found = R.mask_instances(rows, "scores", F.lit(8), F.lit(8), 0.15, box)
    text = F.array_join(F.transform("mask", lambda b: b.cast("int").cast("string")), "")
    return found.select("vec_id", "rx0", "ry0", "rx1", "ry1", text.alias("mask"), "x0", "y1")


#: A crop box for each raster, cut to whole pixels; the raster is what the model made of the crop, resized to 8 x 8.
CROPPED = INSTANCE + """, cb AS (SELECT vec_id, CAST(trunc(10 + 40 * abs(e0)) AS INTEGER) AS cx0, CAST(trunc(5 + 40 * abs(e1)) AS INTEGER) AS cy0, CAST(trunc(40 + 60 * abs(e2)) AS INTEGER) AS cx1, CAST(trunc(50 + 60 * abs(e3)) AS INTEGER) AS cy1 FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1, CAST(embedding[3] AS DOUBLE) AS e2, CAST(embedding[4] AS DOUBLE) AS e3 FROM embeddings)),
rn AS (SELECT vec_id, rx0, ry0, rx1 - rx0 AS ow, ry1 - ry0 AS oh, CAST(floor(rx0 / (8e0 / (cx1 - cx0)) + cx0) AS INTEGER) AS nx0, CAST(floor(ry0 / (8e0 / (cy1 - cy0)) + cy0) AS INTEGER) AS ny0, CAST(ceil(rx1 / (8e0 / (cx1 - cx0)) + cx0) AS INTEGER) AS nx1, CAST(ceil(ry1 / (8e0 / (cy1 - cy0)) + cy0) AS INTEGER) AS ny1 FROM rg JOIN cb USING (vec_id) WHERE cx1 > cx0 AND cy1 > cy0),
gr AS (SELECT *, CAST(gu AS INTEGER) AS i, CAST(gv AS INTEGER) AS j FROM rn, LATERAL (SELECT unnest(generate_series(0, nx1 - nx0 - 1)) AS gu), LATERAL (SELECT unnest(generate_series(0, ny1 - ny0 - 1)) AS gv)),
sm AS (SELECT gr.*, least(ow - 1, CAST(floor((i + 0.5e0) * ow / (nx1 - nx0)) AS INTEGER)) + rx0 AS u, least(oh - 1, CAST(floor((j + 0.5e0) * oh / (ny1 - ny0)) AS INTEGER)) + ry0 AS v FROM gr)
SELECT vec_id, nx0 AS rx0, ny0 AS ry0, nx1 AS rx1, ny1 AS ry1, CAST(count(*) FILTER (WHERE e > 0.15e0) AS BIGINT) AS n, CAST(coalesce(sum((j * (nx1 - nx0) + i) % 1009) FILTER (WHERE e > 0.15e0), 0) AS BIGINT) AS places FROM sm JOIN px USING (vec_id, u, v) GROUP BY vec_id, nx0, ny0, nx1, ny1"""


@query("m5_f25_crop_instances_to_original", CROPPED)
def _(fx):
    """Masks of resized crops, back in the original image: region, and number and places of its true pixels."""
    e = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    crop = D.crop_window(10 + 40 * e(0), 5 + 40 * e(1), 40 + 60 * e(2), 50 + 60 * e(3))
    names = ("cx0", "cy0", "cx1", "cy1")
    rows = fx.raw("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("scores"), *(c.alias(n) for n, c in zip(names, crop, strict=True))).where("cx1 > cx0 AND cy1 > cy0")
    found = R.mask_instances(rows, "scores", F.lit(8), F.lit(8), 0.15)
    back = R.instances_to_original(found, (1600, 900), tuple(F.col(n) for n in names), (8, 8))
    places = F.filter(F.transform("mask", lambda b, i: F.when(b, i)), lambda i: i.isNotNull())
    return back.select("vec_id", "rx0", "ry0", "rx1", "ry1", F.size(places).cast("long").alias("n"), F.aggregate(places, F.lit(0).cast("long"), lambda a, i: a + i % 1009).alias("places"))


@query("p21_labelled_prompt_points", POLYGON.format(d=6) + ", pp AS (SELECT vec_id, i, x * 20 - 1 AS x, y * 20 - 2 AS y, i % 2 AS label FROM pt) SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS INTEGER) AS nth, round(x, 4) AS x, round(y, 4) AS y, label FROM pp WHERE x >= 0 AND x < 3 AND y >= 0 AND y < 4")
def _(fx):
    """Points with labels 0 and 1 in turn, moved to a crop from (1, 2) to (4, 6); those inside, with their labels."""
    rows = polygon(fx, 6).select("vec_id", F.transform("points", lambda p: F.struct((p["x"] * 20).alias("x"), (p["y"] * 20).alias("y"))).alias("points"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (i % 2).cast("int")).alias("labels"))
    points, labels = D.prompt_points(F.col("points"), F.col("labels"), tuple(F.lit(c) for c in (1, 2, 4, 6)))
    both = rows.select("vec_id", F.posexplode(F.arrays_zip(points.alias("point"), labels.alias("label"))).alias("nth", "p"))
    return both.select("vec_id", "nth", F.round("p.point.x", 4).alias("x"), F.round("p.point.y", 4).alias("y"), F.col("p.label").alias("label"))
