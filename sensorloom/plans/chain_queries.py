"""The detector's whole call: scores, thresholds, two levels of suppression and pixel boxes, in one plan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import detect as D
from .raster_queries import SCORES, nms_sql, recursive
from .registry import query

#: Labels are stretches of sixteen tokens; the first two share a group.
PROMPT = {"vehicle": [(0, 0, 16), (1, 16, 32)], "two_wheeler": [(2, 32, 48)], "pedestrian": [(3, 48, 64)]}
SWEEP = {"vehicle": [0.50, 0.52, 0.505], "two_wheeler": [0.50, 0.51], "pedestrian": [0.49, 0.515]}
SWEEP_SQL = ", ".join(f"('{g}', {i}, {t}e0)" for g, own in SWEEP.items() for i, t in enumerate(own))
#: Each threshold's boxes are suppressed by themselves.
CHAIN = recursive(
    SCORES
    + f""", gs AS (SELECT frame_id, query_idx, category_group, label_idx, round(score, 12) AS score FROM sc JOIN (VALUES (0, 'vehicle'), (1, 'vehicle'), (2, 'two_wheeler'), (3, 'pedestrian')) AS g(label_idx, category_group) USING (label_idx)
  QUALIFY row_number() OVER (PARTITION BY frame_id, query_idx, category_group ORDER BY round(score, 12) DESC, label_idx) = 1),
cb AS (SELECT gs.*, threshold_idx, greatest(d.cx - d.w / 2, 0) AS x0, greatest(d.cy - d.h / 2, 0) AS y0, least(d.cx + d.w / 2, 1) AS x1, least(d.cy + d.h / 2, 1) AS y1
  FROM gs JOIN fx_detection d USING (frame_id, query_idx) JOIN (VALUES {SWEEP_SQL}) AS t(category_group, threshold_idx, threshold) USING (category_group) WHERE gs.score > threshold)"""
    + nms_sql("(SELECT * FROM cb WHERE x1 > x0 AND y1 > y0)", "frame_id, category_group, threshold_idx, label_idx", "0.6e0", "n1")
    + nms_sql("(SELECT frame_id, category_group, threshold_idx, label_idx, query_idx, score, x0, y0, x1, y1 FROM n1)", "frame_id, category_group, threshold_idx", "0.85e0", "n2")
)
PIXELS = "round(x0 * 1600, 4) AS x0, round(y0 * 900, 4) AS y0, round(x1 * 1600, 4) AS x1, round(y1 * 900, 4) AS y1"


def chain(fx):
    return D.detect(fx.detection, PROMPT, SWEEP, ["frame_id"], (1600, 900))


def pixels():
    return [F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")]


@query("d9_detector_chain", CHAIN + f" SELECT frame_id, category_group, threshold_idx, query_idx, label_idx, round(score, 6) AS score, {PIXELS} FROM n2")
def _(fx):
    """Boxes of each frame, group and threshold."""
    return chain(fx).select("frame_id", "category_group", "threshold_idx", "query_idx", "label_idx", F.round("score", 6).alias("score"), *pixels())


@query("d10_second_threshold_boxes", CHAIN + f" SELECT frame_id, category_group, query_idx, label_idx, row_number() OVER (PARTITION BY frame_id, category_group ORDER BY score DESC, query_idx) AS nth, {PIXELS} FROM n2 WHERE threshold_idx = 1")
def _(fx):
    """The second threshold's boxes are the result, best first."""
    order = Window.partitionBy("frame_id", "category_group").orderBy(F.desc("score"), "query_idx")
    return chain(fx).where("threshold_idx = 1").select("frame_id", "category_group", "query_idx", "label_idx", F.row_number().over(order).alias("nth"), *pixels())


@query("a3_boxes_per_threshold", CHAIN + " SELECT frame_id, category_group, threshold_idx, count(*) AS n FROM n2 GROUP BY 1, 2, 3")
def _(fx):
    """What is left after suppression, per frame, group and threshold."""
    return chain(fx).groupBy("frame_id", "category_group", "threshold_idx").agg(F.count("*").alias("n"))
