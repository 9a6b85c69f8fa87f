"""Detector post-processing: prompts, label scores, box conversion, greedy non-maximum suppression, threshold sweeps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import on_workers
from .grouped import starts, whole_groups


def canonical_label(label: Column) -> Column:
    """Lower case, white space stripped, trailing full stops stripped."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), r"^\s+|\s+$", ""), r"[.]+$", "")


def prompt_phrase(label: Column) -> Column:
    """Underscores become spaces, runs of white space one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(label, "_", " "), r"\s+", " "))


def prompt_labels(labels: DataFrame, keys: list[str], label: str = "label", order: str = "pos") -> DataFrame:
    """The distinct canonical labels of each prompt, first wins: position, phrase and character span in the caption."""
    rows = labels.withColumn("label", canonical_label(F.col(label))).where("label <> ''")
    rows = rows.groupBy(*keys, "label").agg(F.min(order).alias("first"))
    rows = rows.withColumn("phrase", prompt_phrase(F.col("label")))
    order_by = Window.partitionBy(*keys).orderBy("first", "label")
    before = order_by.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("phrase") + 2).over(before), F.lit(0))
    return rows.select(*keys, "label", "phrase", (F.row_number().over(order_by) - 1).alias("nth"), start.cast("int").alias("span_start"), (start + F.length("phrase")).cast("int").alias("span_end"))


def captions(prompts: DataFrame, keys: list[str]) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("nth", "phrase")))
    return prompts.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: F.concat(p["phrase"], F.lit("."))), " ").alias("caption"), F.count("*").alias("n_labels"))


def conflicts(prompts: DataFrame, keys: list[str]) -> DataFrame:
    """Phrases that two labels share: an error in a prompt."""
    return prompts.groupBy(*keys, "phrase").agg(F.count_distinct("label").alias("n_labels")).where("n_labels > 1")


#: Labels of one prompt: its text has some hundred tokens.
MAX_SPANS = 4_096


def label_scores(detections: DataFrame, spans: DataFrame, keys: list[str], logits: str = "logits") -> DataFrame:
    """Mean token probability of each label's span (label_idx, first, end) for each query, by slices of its tokens.

    spans: one prompt's labels, MAX_SPANS at most (more is an error). They meet the queries as one row that holds them all;
    empty spans give no score.
    """
    prompt = spans.agg(F.collect_list(F.struct("label_idx", F.col("first").cast("int").alias("first"), F.col("end").cast("int").alias("end"))).alias("_spans"))
    prompt = prompt.select(F.when(F.size("_spans") <= MAX_SPANS, F.col("_spans")).otherwise(F.raise_error(F.lit(f"a prompt has over {MAX_SPANS} labels")).cast(prompt.schema["_spans"].dataType)).alias("_spans"))
    probability = F.transform(logits, lambda x: 1 / (1 + F.exp(-x.cast("double"))))
    rows = detections.select(*keys, probability.alias("_p")).crossJoin(F.broadcast(prompt))  # one row
    rows = rows.select(*keys, "_p", F.explode("_spans").alias("_s"))
    tokens = F.slice("_p", F.col("_s.first") + 1, F.greatest(F.col("_s.end") - F.col("_s.first"), F.lit(0)))
    rows = rows.select(*keys, F.col("_s.label_idx").alias("label_idx"), tokens.alias("_t")).where(F.size("_t") > 0)
    return rows.select(*keys, "label_idx", (F.aggregate("_t", F.lit(0.0), lambda a, x: a + x) / F.size("_t")).alias("score"))


def best_label(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The label with the highest score per query, the first of equals."""
    return scores.groupBy(*keys).agg(F.max_by("label_idx", F.struct("score", -F.col("label_idx"))).alias("label_idx"), F.max("score").alias("score"))


def corners_clamped(rows: DataFrame) -> DataFrame:
    """Centre and size to corners, clamped to the unit square; degenerate boxes go."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumns({"x0": clamp(F.col("cx") - F.col("w") / 2), "y0": clamp(F.col("cy") - F.col("h") / 2), "x1": clamp(F.col("cx") + F.col("w") / 2), "y1": clamp(F.col("cy") + F.col("h") / 2)})
    return rows.where("x1 > x0 AND y1 > y0")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two corner structs (x0, y0, x1, y1)."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return w * h / (area(a) + area(b) - w * h)


def survivors(boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Which of some boxes (n, 4), best first, stay: one goes if a better one that stays overlaps it by more than threshold.

    An alive flag for each box; every box that stays clears the flags of those behind it at once.
    """
    x0, y0, x1, y1 = np.ascontiguousarray(boxes.T)
    area = (x1 - x0) * (y1 - y0)
    alive = np.ones(len(boxes), bool)
    behind = np.arange(len(boxes))
    with np.errstate(divide="ignore", invalid="ignore"):
        while len(behind):
            k, behind = behind[0], behind[1:]
            w = np.maximum(np.minimum(x1[k], x1[behind]) - np.maximum(x0[k], x0[behind]), 0)
            lap = w * np.maximum(np.minimum(y1[k], y1[behind]) - np.maximum(y0[k], y0[behind]), 0)
            gone = lap / (area[k] + area[behind] - lap) > threshold
            alive[behind[gone]] = False
            behind = behind[~gone]
    return alive


def _suppressed(rows: DataFrame, keys: list[str], levels: Sequence[tuple[str | None, float]]) -> DataFrame:
    """Rows sorted by keys and rank inside partitions -> those that stay. levels: (column whose values stand apart, threshold), in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, keys):
            boxes = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")])
            edges = [*starts(batch, keys).tolist(), batch.num_rows]
            parts = {c: batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c, _ in levels if c is not None}
            stay = np.ones(batch.num_rows, bool)
            for a, b in zip(edges, edges[1:], strict=False):
                for column, threshold in levels:
                    own = a + np.flatnonzero(stay[a:b])
                    for label in np.unique(parts[column][own]) if column is not None else (None,):
                        some = own if column is None else own[parts[column][own] == label]
                        if len(some) > 1:
                            stay[some] = survivors(boxes[some], threshold)
            yield batch.filter(pa.array(stay))

    on_workers(rows.sparkSession)
    return rows.mapInArrow(run, rows.schema)


def suppress(boxes: DataFrame, keys: list[str], threshold: float, score: str = "score", tie: str = "query_idx") -> DataFrame:
    """Greedy non-maximum suppression within keys: best score first, a box goes if a kept one overlaps it by more than threshold.

    Groups are sorted runs of packed coordinates in Arrow batches; a group is one frame's detections, bounded by the
    detector's queries.
    """
    ranked = boxes.repartition(*keys).sortWithinPartitions(*keys, F.desc(score), tie)
    return _suppressed(ranked, keys, [(None, threshold)])


#: A prompt's labels by group: (number, first token, end token).
Prompt = dict[str, list[tuple[int, int, int]]]


def best_in_groups(detections: DataFrame, prompt: Prompt, logits: str = "logits", group: str = "category_group") -> DataFrame:
    """Each query once for each group of the prompt: its best label there (the first of equals) and that label's score.

    A prompt is a parameter of some hundred tokens at most, so spans are constants of the plan: nothing is joined or moved.
    """
    probability = F.transform(logits, lambda x: 1 / (1 + F.exp(-x.cast("double"))))

    def best(spans: list[tuple[int, int, int]]) -> Column:
        found = []
        for number, first, end in spans:
            if end > first:
                tokens = F.slice("_p", first + 1, end - first)
                score = F.aggregate(tokens, F.lit(0.0), lambda a, x: a + x) / F.size(tokens)
                found.append(F.struct(F.round(score, 12).alias("rank"), F.lit(-number).alias("last"), score.alias("score")))
        return F.array_max(F.array(*found))

    rows = detections.withColumn("_p", probability)
    groups = [F.struct(F.lit(name).alias(group), best(spans).alias("_best")) for name, spans in prompt.items() if any(end > first for _, first, end in spans)]
    rows = rows.select(*detections.columns, F.inline(F.array(*groups)))
    return rows.select(*detections.columns, group, (-F.col("_best.last")).alias("label_idx"), F.col("_best.rank").alias("score"))


def detect(detections: DataFrame, prompt: Prompt, thresholds: dict[str, list[float]], keys: list[str], size: tuple[int, int], same: float = 0.6, cross: float = 0.85, query: str = "query_idx") -> DataFrame:
    """Raw detector output (keys, query, logits, cx, cy, w, h) -> boxes in pixels for each group and each of its score thresholds.

    Scores are the labels' mean token probabilities to twelve places; boxes strictly over a threshold are clamped, suppressed
    among their label, then among their group, and scaled to the image. Rows: keys, category_group, threshold_idx, query,
    label_idx, score, x0, y0, x1, y1.

    A box that a higher threshold drops has a lower score than all that stay, so it suppressed none of them: what stays at a
    threshold is what stays at the lowest one, above it. So boxes move and are suppressed once, for all thresholds together.
    """
    group = "category_group"
    cuts = {g: sorted(enumerate(t), key=lambda p: p[1]) for g, t in thresholds.items() if t and g in prompt}
    least = F.lit(None).cast("double")
    for g, own in cuts.items():
        least = F.when(F.col(group) == g, own[0][1]).otherwise(least)
    rows = best_in_groups(detections.select(*keys, query, "logits", "cx", "cy", "w", "h"), {g: prompt[g] for g in cuts})
    rows = corners_clamped(rows.where(F.col("score") > least)).select(*keys, group, query, "label_idx", "score", "x0", "y0", "x1", "y1")
    frame = [*keys, group]
    ranked = rows.repartition(*frame).sortWithinPartitions(*frame, F.desc("score"), query)
    kept = _suppressed(ranked, frame, [("label_idx", same), (None, cross)])
    every = F.array().cast("array<struct<threshold_idx:int,threshold:double>>")
    for g, own in cuts.items():
        every = F.when(F.col(group) == g, F.array(*(F.struct(F.lit(i).alias("threshold_idx"), F.lit(float(t)).alias("threshold")) for i, t in own))).otherwise(every)
    passed = kept.withColumn("_t", F.explode(F.filter(every, lambda t: F.col("score") > t["threshold"])))
    width, height = size
    return passed.select(*frame, "_t.threshold_idx", query, "label_idx", "score", *((F.col(c) * n).alias(c) for c, n in (("x0", width), ("y0", height), ("x1", width), ("y1", height))))


def swept(boxes: DataFrame, thresholds: DataFrame, key: str) -> DataFrame:
    """Boxes at each of their group's thresholds, strictly above it. Thresholds meet boxes on the group, in one row for each group.

    Boxes come from exploded scores, so the join is set: groups and their thresholds are a parameter, a few rows.
    """
    lists = thresholds.groupBy(key).agg(F.collect_list(F.struct("threshold_idx", "threshold")).alias("_t"))
    return boxes.join(lists.hint("shuffle_hash"), key).withColumn("_t", F.explode("_t")).select("*", "_t.threshold_idx", "_t.threshold").drop("_t").where("score > threshold")


def group_index(rows: DataFrame, keys: list[str], group: str, order: list[str]) -> DataFrame:
    """Adds nms_index: the number of a row's suppression group among its key's groups, by first appearance from 0."""
    item = F.min(F.struct(*order)).over(Window.partitionBy(*keys, group))
    return rows.withColumn("_first", item).withColumn("nms_index", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first", group)) - 1).drop("_first")


def exclusive_group(label: Column, groups: dict[str, str]) -> Column:
    """A label's suppression group; labels that none lists stand alone."""
    out = F.concat(F.lit("__label__:"), label.cast("string"))
    for name, group in groups.items():
        out = F.when(label.cast("string") == name, group).otherwise(out)
    return out


def crop_window(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, ...]:
    """A crop box in whole pixels, cut towards zero."""
    return tuple(c.cast("int") for c in (x0, y0, x1, y1))


def prompt_points(points: Column, labels: Column, crop: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """Prompt points (x, y) moved into a crop, and their labels; those outside it go. As many labels as points, or an error."""
    left, top, right, bottom = crop
    same = F.when(F.size(points) == F.size(labels), F.arrays_zip(points.alias("point"), labels.alias("label"))).otherwise(F.raise_error(F.lit("a prompt has as many labels as points")).cast("array<struct<point:struct<x:double,y:double>,label:int>>"))
    moved = F.transform(same, lambda z: F.struct((z["point"]["x"] - left).alias("x"), (z["point"]["y"] - top).alias("y"), z["label"].alias("label")))
    kept = F.filter(moved, lambda p: (p["x"] >= 0) & (p["x"] < right - left) & (p["y"] >= 0) & (p["y"] < bottom - top))
    return F.transform(kept, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.transform(kept, lambda p: p["label"])
