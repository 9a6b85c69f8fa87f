"""Detector, mask and depth queries over detections and 8x8 rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import raster as R
from .registry import query, r6, rounded

K8 = (6.33, 6.33, 4.08, 2.455)
PX = "WITH px AS (SELECT vec_id, CAST(p AS INTEGER) // 8 AS v, CAST(p AS INTEGER) % 8 AS u, CAST(embedding[p + 1] AS DOUBLE) AS e FROM embeddings, LATERAL (SELECT unnest(generate_series(0, 63)) AS p))"
DEPTH = PX + ", dp AS (SELECT *, 5e0 + 100e0 * abs(e) AS z, e > 0 AS mask, e < -0.2e0 AS sky FROM px)"
MASK = PX + ", mk AS (SELECT vec_id, u, v FROM px WHERE e > 0.1e0)"


def raster(fx):
    rows = R.pixels(fx.raw("embeddings"), "embedding", 8, ["vec_id"], "e").withColumn("e", F.col("e").cast("double"))
    return rows.withColumns({"z": 5.0 + 100.0 * F.abs("e"), "mask": F.col("e") > 0, "sky": F.col("e") < -0.2})


def mask(fx):
    return raster(fx).where("e > 0.1D").select("vec_id", "u", "v")


@query("p18_depth_cut_off", DEPTH + "SELECT vec_id, count(*) AS n FROM dp WHERE z <= 12 GROUP BY 1")
def _(fx):
    return R.kept_pixels(raster(fx), cut_off=12.0).groupBy("vec_id").agg(F.count("*").alias("n"))


@query("p19_j19_mask_filter", DEPTH + "SELECT vec_id, count(*) AS n, round(sum(z), 6) AS z FROM dp WHERE mask GROUP BY 1")
def _(fx):
    return R.kept_pixels(raster(fx), mask=F.col("mask")).groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.sum("z"), 6).alias("z"))


@query("p20_sky", DEPTH + "SELECT vec_id, count(*) AS n FROM dp WHERE NOT sky GROUP BY 1")
def _(fx):
    return R.kept_pixels(raster(fx), sky=F.col("sky")).groupBy("vec_id").agg(F.count("*").alias("n"))


POINTS = "round((u - 4.08e0) * z / 6.33e0, 6) + 0e0 AS x, round((v - 2.455e0) * z / 6.33e0, 6) + 0e0 AS y, round(z, 6) AS z"


@query("c1_depth_points", DEPTH + f"SELECT vec_id, u, v, {POINTS} FROM dp WHERE z <= 30 AND mask")
def _(fx):
    return R.depth_points(R.kept_pixels(raster(fx), 30.0, F.col("mask")), K8).select("vec_id", "u", "v", *rounded(x="x", y="y", z="z"))


@query("c3_pseudo_lidar", DEPTH + f"SELECT vec_id, u, v, {POINTS} FROM dp WHERE NOT sky AND mask")
def _(fx):
    return R.depth_points(R.kept_pixels(raster(fx), mask=F.col("mask"), sky=F.col("sky")), K8).select("vec_id", "u", "v", *rounded(x="x", y="y", z="z"))


@query("c2_metric_depth", DEPTH + "SELECT vec_id, round(avg(CASE WHEN vec_id % 2 = 0 THEN z * 6.33e0 / 300 ELSE z END), 6) AS z FROM dp GROUP BY 1")
def _(fx):
    model = F.when(F.col("vec_id") % 2 == 0, "DA3METRIC-LARGE").otherwise("DA3NESTED-GIANT-LARGE")
    fx_, fy_, _, _ = R.scaled_intrinsics((1266.0, 1266.0, 816.0, 491.0), 8 / 1600, 8 / 1600)
    return raster(fx).groupBy("vec_id").agg(F.round(F.avg(R.metric_depth(F.col("z"), model, fx_, fy_)), 6).alias("z"))


@query("a11_voxels", DEPTH + ", pt AS (SELECT vec_id, (u - 4.08e0) * z / 6.33e0 AS x, (v - 2.455e0) * z / 6.33e0 AS y, z FROM dp), lo AS (SELECT vec_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pt GROUP BY 1) SELECT vec_id, CAST(floor((x - lx + 2) / 4) AS BIGINT) AS ix, CAST(floor((y - ly + 2) / 4) AS BIGINT) AS iy, CAST(floor((z - lz + 2) / 4) AS BIGINT) AS iz, count(*) AS n_points, round(avg(x), 6) + 0e0 AS x FROM pt JOIN lo USING (vec_id) GROUP BY 1, 2, 3, 4")
def _(fx):
    cloud = R.depth_points(raster(fx), K8).select("vec_id", "x", "y", "z")
    return R.voxels(cloud, 4.0, ["vec_id"]).select("vec_id", "ix", "iy", "iz", "n_points", r6("x").alias("x"))


@query("u1_a14_tagged_union", DEPTH + "SELECT source, vec_id, count(*) AS n FROM (SELECT 'pseudo' AS source, vec_id FROM dp WHERE mask UNION ALL SELECT 'measured', vec_id FROM dp WHERE z <= 12) GROUP BY 1, 2")
def _(fx):
    a = R.kept_pixels(raster(fx), mask=F.col("mask")).select(F.lit("pseudo").alias("source"), "vec_id")
    b = R.kept_pixels(raster(fx), cut_off=12.0).select(F.lit("measured").alias("source"), "vec_id")
    return a.unionByName(b).groupBy("source", "vec_id").agg(F.count("*").alias("n"))


@query("a8_p17_mask_regions", MASK + "SELECT vec_id, min(u) AS x0, min(v) AS y0, max(u) + 1 AS x1, max(v) + 1 AS y1, count(*) AS n_pixels FROM mk GROUP BY 1")
def _(fx):
    return R.mask_regions(mask(fx), ["vec_id"])


@query("m4_mask_instances", MASK + "SELECT vec_id, u - min(u) OVER w AS ru, v - min(v) OVER w AS rv FROM mk WINDOW w AS (PARTITION BY vec_id)")
def _(fx):
    pixels = mask(fx)
    return R.rebased(pixels, R.mask_regions(pixels, ["vec_id"]), ["vec_id"]).select("vec_id", "ru", "rv")


@query("m2_paste_mask", MASK + "SELECT vec_id, u + 5 AS u, v - 3 AS v FROM mk WHERE u + 5 < 12 AND v - 3 >= 0")
def _(fx):
    return R.pasted(mask(fx), 5, -3, 12, 10)


@query("m1_resize_mask", "SELECT vec_id, CAST(p AS INTEGER) AS p, embedding[least(7, CAST(floor((p // 5 + 0.5e0) * 8 / 3) AS INTEGER)) * 8 + least(7, CAST(floor((p % 5 + 0.5e0) * 8 / 5) AS INTEGER)) + 1] > 0 AS bit FROM embeddings, LATERAL (SELECT unnest(generate_series(0, 14)) AS p)")
def _(fx):
    bits = F.transform("embedding", lambda e: e > 0)
    return fx.raw("embeddings").select("vec_id", F.posexplode(R.resized_nearest(bits, 8, 8, 3, 5)).alias("p", "bit"))


def morphed(fx, sizes):
    """True pixels of the masks after morphology, which works on each row's array; pixels are what the result is."""
    bits = R.morphology(F.transform("embedding", lambda e: e.cast("double") > 0.1), F.lit(8), F.lit(8), sizes)
    return R.pixels(fx.raw("embeddings").select("vec_id", bits.alias("bits")), "bits", 8, ["vec_id"], "bit").where("bit").select("vec_id", "u", "v")


KERNEL3 = "(VALUES (0, -1), (-1, 0), (0, 0), (1, 0), (0, 1)) AS k(du, dv)"


@query("m3_dilate", MASK + f"SELECT DISTINCT vec_id, u - du AS u, v - dv AS v FROM mk, {KERNEL3} WHERE u - du BETWEEN 0 AND 7 AND v - dv BETWEEN 0 AND 7")
def _(fx):
    return morphed(fx, [3])


@query("m3_erode", MASK + f"SELECT m.vec_id, m.u, m.v FROM mk m WHERE NOT EXISTS (SELECT 1 FROM {KERNEL3} WHERE m.u + du BETWEEN 0 AND 7 AND m.v + dv BETWEEN 0 AND 7 AND NOT EXISTS (SELECT 1 FROM mk n WHERE n.vec_id = m.vec_id AND n.u = m.u + du AND n.v = m.v + dv))")
def _(fx):
    return morphed(fx, [-3])


SCORES = """WITH tk AS (SELECT vec_id - vec_id % 900 AS frame_id, vec_id AS query_idx, CAST(t AS INTEGER) AS t, 1 / (1 + exp(-CAST(embedding[t + 1] AS DOUBLE))) AS p FROM embeddings, LATERAL (SELECT unnest(generate_series(0, 63)) AS t)),
sc AS (SELECT frame_id, query_idx, t // 16 AS label_idx, avg(p) AS score FROM tk GROUP BY 1, 2, 3),
bl AS (SELECT frame_id, query_idx, label_idx, score FROM sc QUALIFY row_number() OVER (PARTITION BY frame_id, query_idx ORDER BY round(score, 12) DESC, label_idx) = 1)"""
BOX = SCORES + """, bx AS (SELECT bl.*, greatest(d.cx - d.w / 2, 0) AS x0, greatest(d.cy - d.h / 2, 0) AS y0, least(d.cx + d.w / 2, 1) AS x1, least(d.cy + d.h / 2, 1) AS y1
  FROM bl JOIN fx_detection d USING (frame_id, query_idx))"""


def spans(fx):
    return fx.spark.range(4).select(F.col("id").cast("int").alias("label_idx"), (F.col("id") * 16).alias("first"), (F.col("id") * 16 + 16).alias("end"))


def scored(fx):
    found = fx.detection
    best = D.best_label(D.label_scores(found, spans(fx), ["frame_id", "query_idx"]), ["frame_id", "query_idx"])
    return D.corners_clamped(best.join(found.drop("logits").hint("merge"), ["frame_id", "query_idx"]))  # best comes from exploded rows


@query("j17_a7_d4_label_scores", SCORES + "SELECT frame_id, query_idx, label_idx, round(score, 6) AS score FROM sc")
def _(fx):
    return D.label_scores(fx.detection, spans(fx), ["frame_id", "query_idx"]).select("frame_id", "query_idx", "label_idx", r6("score").alias("score"))


@query("a6_best_label", SCORES + "SELECT frame_id, query_idx, label_idx, round(score, 6) AS score FROM bl")
def _(fx):
    return D.best_label(D.label_scores(fx.detection, spans(fx), ["frame_id", "query_idx"]), ["frame_id", "query_idx"]).select("frame_id", "query_idx", "label_idx", r6("score").alias("score"))


@query("p14_score_threshold", SCORES + "SELECT frame_id, query_idx FROM bl WHERE score > 0.52e0")
def _(fx):
    return scored(fx).where("score > 0.52D").select("frame_id", "query_idx")


@query("d5_p15_clamped_boxes", BOX + "SELECT frame_id, query_idx, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM bx WHERE x1 > x0 AND y1 > y0")
def _(fx):
    return scored(fx).select("frame_id", "query_idx", *rounded(x0="x0", y0="y0", x1="x1", y1="y1"))


@query("p24_pixel_boxes", BOX + "SELECT frame_id, query_idx, round(x0 * 1600, 4) AS x0, round(y1 * 900, 4) AS y1 FROM bx")
def _(fx):
    return scored(fx).select("frame_id", "query_idx", F.round(F.col("x0") * 1600, 4).alias("x0"), F.round(F.col("y1") * 900, 4).alias("y1"))


def nms_sql(source: str, keys: str, limit: str, out: str) -> str:
    """Greedy suppression as a recursive walk over ranks that carries the kept boxes."""
    lap = "greatest(least(k.x1, r.x1) - greatest(k.x0, r.x0), 0) * greatest(least(k.y1, r.y1) - greatest(k.y0, r.y0), 0)"
    union = f"((k.x1 - k.x0) * (k.y1 - k.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) - {lap})"
    on = " AND ".join(f"r.{k} = w.{k}" for k in keys.split(", "))
    return f""", {out}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 12) DESC, query_idx) AS rk FROM {source}),
{out}_w AS (SELECT {keys}, 1 AS rk, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'q': query_idx}}] AS kept FROM {out}_r WHERE rk = 1
  UNION ALL SELECT {", ".join("w." + k for k in keys.split(", "))}, r.rk, CASE WHEN len(list_filter(w.kept, lambda k: {lap} / {union} > {limit})) > 0 THEN w.kept ELSE list_append(w.kept, {{'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1, 'q': r.query_idx}}) END
  FROM {out}_w w JOIN {out}_r r ON {on} AND r.rk = w.rk + 1),
{out} AS (SELECT r.* FROM {out}_r r JOIN (SELECT {keys}, unnest(list_transform(k, lambda x: x.q)) AS query_idx FROM (SELECT {keys}, arg_max(kept, rk) AS k FROM {out}_w GROUP BY {keys})) USING ({keys}, query_idx))"""


def recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql.removeprefix("WITH ")


def same_label(fx):
    return D.suppress(scored(fx).select("frame_id", "label_idx", "query_idx", F.round("score", 12).alias("score"), "x0", "y0", "x1", "y1"), ["frame_id", "label_idx"], 0.6)


@query("d6_j18_same_label_nms", recursive(BOX + nms_sql("bx", "frame_id, label_idx", "0.6e0", "n1") + " SELECT frame_id, label_idx, query_idx FROM n1"))
def _(fx):
    return same_label(fx).select("frame_id", "label_idx", "query_idx")


@query("d7_d9_cross_label_nms", recursive(BOX + nms_sql("bx", "frame_id, label_idx", "0.6e0", "n1") + nms_sql("(SELECT frame_id, label_idx, query_idx, score, x0, y0, x1, y1 FROM n1)", "frame_id", "0.85e0", "n2") + " SELECT frame_id, label_idx, query_idx FROM n2"))
def _(fx):
    return D.suppress(same_label(fx), ["frame_id"], 0.85).select("frame_id", "label_idx", "query_idx")


THRESHOLDS = "(VALUES (0, 0, 0.50e0), (0, 1, 0.52e0), (1, 0, 0.51e0), (1, 1, 0.53e0), (2, 0, 0.50e0), (3, 0, 0.52e0)) AS th(label_idx, threshold_idx, threshold)"


@query("j14_a3_threshold_sweep", BOX + f"SELECT frame_id, label_idx, threshold_idx, count(*) AS n FROM bx JOIN {THRESHOLDS} USING (label_idx) WHERE score > threshold GROUP BY 1, 2, 3")
def _(fx):
    th = fx.spark.sql("SELECT * FROM VALUES (0, 0, 0.50D), (0, 1, 0.52D), (1, 0, 0.51D), (1, 1, 0.53D), (2, 0, 0.50D), (3, 0, 0.52D) AS th(label_idx, threshold_idx, threshold)")
    return D.swept(scored(fx), th, "label_idx").groupBy("frame_id", "label_idx", "threshold_idx").agg(F.count("*").alias("n"))


PART = "WITH lb AS (SELECT p_brand, p_partkey AS pos, p_type || '. ' AS label FROM part)"
CANON = ", cn AS (SELECT p_brand, regexp_replace(regexp_replace(lower(label), '^\\s+|\\s+$', '', 'g'), '[.]+$', '') AS label, pos FROM lb), ds AS (SELECT p_brand, label, min(pos) AS first FROM cn WHERE label <> '' GROUP BY 1, 2)"


def part_prompts(fx):
    rows = fx.raw("part").select("p_brand", F.col("p_partkey").alias("pos"), F.concat("p_type", F.lit(". ")).alias("label"))
    return D.prompt_labels(rows, ["p_brand"])


@query("d1_d2_w9_prompt_spans", PART + CANON + " SELECT p_brand, label, row_number() OVER w - 1 AS nth, CAST(coalesce(sum(length(label) + 2) OVER (PARTITION BY p_brand ORDER BY first, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS span_start FROM ds WINDOW w AS (PARTITION BY p_brand ORDER BY first, label)")
def _(fx):
    return part_prompts(fx).select("p_brand", "label", "nth", "span_start")


@query("d3_captions", PART + CANON + " SELECT p_brand, string_agg(label || '.', ' ' ORDER BY first, label) AS caption, count(*) AS n_labels FROM ds GROUP BY 1")
def _(fx):
    return D.captions(part_prompts(fx), ["p_brand"])


@query("o5_w6_top_masks", "SELECT label, vec_id, rk FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rk FROM embeddings) WHERE rk <= 3")
def _(fx):
    from pyspark.sql import Window

    order = Window.partitionBy("label").orderBy(F.desc(F.col("embedding")[0]), "vec_id")
    return fx.raw("embeddings").select("label", "vec_id", F.row_number().over(order).alias("rk")).where("rk <= 3")
