"""Depth maps and masks: rasters stored as arrays, exploded to pixels only where needed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import on_workers, stored_table
from . import masks
from .boxes import box_to_original, computed


def pixels(rows: DataFrame, values: str, width: int, keys: list[str], name: str = "value") -> DataFrame:
    """One row per pixel: v (row), u (column) and the value."""
    out = rows.select(*keys, F.posexplode(values).alias("p", name))
    return out.withColumns({"v": F.floor(F.col("p") / width).cast("int"), "u": (F.col("p") % width).cast("int")}).drop("p")


def depth_points(depth: DataFrame, k: tuple[float, float, float, float], z: str = "z") -> DataFrame:
    """Pixels (u, v, z) -> camera coordinates x, y, z; k is fx, fy, cx, cy."""
    fx, fy, cx, cy = k
    return depth.withColumns({"x": (F.col("u") - cx) * F.col(z) / fx, "y": (F.col("v") - cy) * F.col(z) / fy})


def kept_pixels(rows: DataFrame, cut_off: float | None = None, mask: Column | None = None, sky: Column | None = None) -> DataFrame:
    """One conjunction: within the cut-off (inclusive), in the mask, not in the sky."""
    for condition in (F.col("z") <= cut_off if cut_off is not None else None, mask, ~sky if sky is not None else None):
        rows = rows if condition is None else rows.where(condition)
    return rows


def metric_depth(depth: Column, model: Column, fx: float, fy: float) -> Column:
    """Relative models scale by focal / 300, metric ones pass; an unknown model is an error. (fixed values: 300, model names)"""
    relative, metric = ["DA3METRIC-LARGE"], ["DA3NESTED-GIANT-LARGE"]
    return F.when(model.isin(relative), depth * ((fx + fy) / 2) / 300.0).when(model.isin(metric), depth).otherwise(F.raise_error(F.concat(F.lit("unknown depth model "), model)).cast("double"))


def scaled_intrinsics(k: tuple[float, float, float, float], sx: float, sy: float) -> tuple[float, float, float, float]:
    return k[0] * sx, k[1] * sy, k[2] * sx, k[3] * sy


def cropped_intrinsics(k: tuple[float, float, float, float], x0: float, y0: float) -> tuple[float, float, float, float]:
    return k[0], k[1], k[2] - x0, k[3] - y0


def mask_regions(mask_pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding rectangle of the true pixels, ends exclusive; empty masks have no row."""
    return mask_pixels.groupBy(*keys).agg(F.min("u").alias("x0"), F.min("v").alias("y0"), (F.max("u") + 1).alias("x1"), (F.max("v") + 1).alias("y1"), F.count("*").alias("n_pixels"))


def rebased(mask_pixels: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels in their region's coordinates."""
    both = mask_pixels.join(regions.hint("merge"), keys)  # both sides are exploded pixels, whose size Spark can't tell
    return both.withColumns({"ru": F.col("u") - F.col("x0"), "rv": F.col("v") - F.col("y0")})


def pasted(mask_pixels: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """Cropped pixels on the full canvas, clipped to it."""
    moved = mask_pixels.withColumns({"u": F.col("u") + x0, "v": F.col("v") + y0})
    return moved.where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))


def resized_nearest(bits: Column, height: Column | int, width: Column | int, new_height: Column | int, new_width: Column | int) -> Column:
    """A row-major mask array resampled: source index int((i + 0.5) * old / new), clipped, per axis. Sizes are the row's or constant."""
    height, width, new_height, new_width = (n if isinstance(n, Column) else F.lit(n) for n in (height, width, new_height, new_width))

    def source(i: Column, old: Column, new: Column) -> Column:
        return F.least(F.greatest(F.floor((i + 0.5) * old / new), F.lit(0)), old - 1).cast("int")

    place = lambda p: source(F.floor(p / new_width), height, new_height) * width + source(p % new_width, width, new_width)
    return F.transform(F.sequence(F.lit(0), (new_height * new_width - 1).cast("int")), lambda p: F.get(bits, place(p)))


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets (du, dv) of an elliptical kernel of the given side; a square for one pixel."""
    r = size // 2
    if r == 0:
        return [(0, 0)]
    out = []
    for dv in range(-r, size - r):
        reach = round(r * max(0.0, 1 - (dv / r) ** 2) ** 0.5) if abs(dv) <= r else 0
        out += [(du, dv) for du in range(-reach, reach + 1) if -r <= du < size - r]
    return out


#: Bits of a cell number on each axis of a packed key: clouds reach some two million cells each way.
CELL_BITS = 21


def voxels(points: DataFrame, size: float, keys: list[str], colours: tuple[str, ...] = ()) -> DataFrame:
    """Mean point, and mean colours, per cell of the given side; cells start half a side below each cloud's least coordinates.

    The cloud is stored, so it is computed once for its least coordinates and its cells; a cell is one packed 64-bit key, and
    its sums merge in each task before anything moves. A cloud of over 2 ** 21 cells on an axis is an error.
    """
    cloud = stored_table(points.select(*keys, "x", "y", "z", *colours), "cloud")
    low = stored_table(cloud.groupBy(*keys).agg(*(F.min(c).alias("_" + c) for c in "xyz")), "cloud-ends")
    number = {c: F.floor((F.col(c) - F.col("_" + c) + size / 2) / size).cast("long") for c in "xyz"}
    fits = number["x"] < 1 << CELL_BITS
    for c in "yz":
        fits = fits & (number[c] < 1 << CELL_BITS)
    packed = F.when(fits, number["x"] * (1 << 2 * CELL_BITS) + number["y"] * (1 << CELL_BITS) + number["z"]).otherwise(F.raise_error(F.lit("a cloud has too many cells of this size")).cast("long"))
    means = [F.avg(c).alias(c) for c in ("x", "y", "z", *colours)]
    cells = cloud.join(low, keys).withColumn("_cell", packed).groupBy(*keys, "_cell").agg(*means, F.count("*").alias("n_points"))
    part = lambda k: F.shiftright("_cell", k * CELL_BITS).bitwiseAND(F.lit((1 << CELL_BITS) - 1))
    return cells.select(*keys, part(2).alias("ix"), part(1).alias("iy"), part(0).alias("iz"), "x", "y", "z", *colours, "n_points")


def _morphed(mask: np.ndarray, size: int) -> np.ndarray:
    """One step on one mask, a kernel row at a time: how many true pixels a run of the kernel covers comes from running sums."""
    height, width = mask.shape
    rows: dict[int, list[int]] = {}
    for du, dv in ellipse(abs(size)):
        rows.setdefault(dv, []).append(du)
    total = np.concatenate([np.zeros((height, 1), np.int64), np.cumsum(mask, axis=1)], axis=1)
    hit, reach = np.zeros((height, width), np.int64), np.zeros((height, width), np.int64)
    across, down = np.arange(width), np.arange(height)
    for dv, own in rows.items():
        lo, hi = np.clip(across + min(own), 0, width), np.clip(across + max(own) + 1, 0, width)
        inside = (down + dv >= 0) & (down + dv < height)
        hit[inside] += (total[:, hi] - total[:, lo])[down[inside] + dv]
        reach[inside] += hi - lo
    return hit > 0 if size > 0 else hit == reach


def morphology(bits: Column, width: Column, height: Column, sizes: list[float], ratio: bool = False) -> Column:
    """Row-major masks dilated (size over 0) and eroded (under 0) in the order of sizes, by elliptical kernels; 0 does nothing.

    ratio: sizes are parts of the mean side of the mask's bounding rectangle, rounded up. Pixels outside the image count for
    neither; an empty mask stays empty and null stays null. Each mask is one row's array, so nothing is shuffled.
    """
    on_workers(SparkSession.active())

    @F.pandas_udf("array<boolean>")
    def run(masks: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
        out = []
        for flat, w, h in zip(masks, widths, heights, strict=True):
            if flat is None or not len(flat) or not np.any(flat):
                out.append(flat)
                continue
            mask = np.asarray(flat, bool).reshape(int(h), int(w))
            own = sizes
            if ratio:
                v, u = np.nonzero(mask)
                side = (int(np.ptp(v)) + int(np.ptp(u)) + 2) / 2
                own = [int(math.copysign(math.ceil(abs(k * side)), k)) if k else 0 for k in sizes]
            for k in own:
                mask = _morphed(mask, int(k)) if k else mask
            out.append(mask.reshape(-1))
        return pd.Series(out, dtype=object)

    return run(bits, width, height)


def mask_instances(rows: DataFrame, values: str, width: Column, height: Column, threshold: float = 0.5, box: tuple[Column, ...] | None = None) -> DataFrame:
    """Masks (row-major scores) -> instances: the region of pixels strictly over threshold (rx0, ry0, rx1, ry1, ends exclusive), the
    mask cut to it, and a box (x0, y0, x1, y1): the prompt's own, or the region. Empty masks go; other columns stay.
    """
    rows = rows.withColumns({"_w": width.cast("int"), "_p": F.filter(F.transform(values, lambda e, i: F.when(e > threshold, i)), lambda i: i.isNotNull())}).where(F.size("_p") > 0)
    us, vs = F.transform("_p", lambda i: i % F.col("_w")), F.transform("_p", lambda i: F.floor(i / F.col("_w")).cast("int"))
    rows = rows.withColumns({"rx0": F.array_min(us), "ry0": F.array_min(vs), "rx1": F.array_max(us) + 1, "ry1": F.array_max(vs) + 1})
    wide = F.col("rx1") - F.col("rx0")
    place = lambda q: (F.floor(q / wide) + F.col("ry0")) * F.col("_w") + q % wide + F.col("rx0")
    mask = F.transform(F.sequence(F.lit(0), wide * (F.col("ry1") - F.col("ry0")) - 1), lambda q: F.get(F.col(values), place(q).cast("int")) > threshold)
    own = box or tuple(F.col(c).cast("double") for c in ("rx0", "ry0", "rx1", "ry1"))
    return rows.withColumns({"mask": mask, **dict(zip(("x0", "y0", "x1", "y1"), own, strict=True))}).drop("_w", "_p")


def instances_to_original(rows: DataFrame, original: tuple, crop: tuple | None = None, input_size: tuple | None = None, normalized: bool = False) -> DataFrame:
    """Instances (box x0.., region rx0.., mask) of a resized crop in its original image.

    The region becomes whole pixels outward and at least one wide and high; the mask is resampled to it. See box_to_original.
    """
    box = box_to_original(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), original, crop, input_size, normalized)
    left, top, right, bottom = box_to_original(tuple(F.col(c) for c in ("rx0", "ry0", "rx1", "ry1")), original, crop, input_size, False)
    old = {"_ow": F.col("rx1") - F.col("rx0"), "_oh": F.col("ry1") - F.col("ry0")}
    low = {"rx0": F.floor(left).cast("int"), "ry0": F.floor(top).cast("int")}
    high = {"rx1": F.greatest(F.ceil(right), F.floor(left) + 1).cast("int"), "ry1": F.greatest(F.ceil(bottom), F.floor(top) + 1).cast("int")}
    rows = rows.withColumns(old | low | high | dict(zip(("x0", "y0", "x1", "y1"), box, strict=True)))
    return rows.withColumn("mask", resized_nearest(F.col("mask"), F.col("_oh"), F.col("_ow"), F.col("ry1") - F.col("ry0"), F.col("rx1") - F.col("rx0"))).drop("_ow", "_oh")


def run_instances_to_original(rows: DataFrame, crop: tuple[Column, ...], input_size: tuple[int, int], mask: str = "mask") -> DataFrame:
    """Masks as runs in a resized crop (input_size) -> runs in the original image, with their region rx0, ry0, rx1, ry1 there.

    The region becomes whole pixels outward, at least one wide and high; the mask is cut to its own region, resampled to the
    new one, and moved to its place. No mask is written out in pixels. Masks are not empty.
    """
    rows = computed(rows, _r=masks.region(F.col(mask)))
    own = tuple(F.col(f"_r.{c}") for c in ("x0", "y0", "x1", "y1"))
    left, top, right, bottom = box_to_original(own, (1, 1), crop, input_size, False)
    low = {"rx0": F.floor(left).cast("int"), "ry0": F.floor(top).cast("int")}
    high = {"rx1": F.greatest(F.ceil(right), F.floor(left) + 1).cast("int"), "ry1": F.greatest(F.ceil(bottom), F.floor(top) + 1).cast("int")}
    rows = computed(rows, **low, **high)
    wide, tall = own[2] - own[0], own[3] - own[1]
    new_wide, new_tall = F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0")
    rows = computed(rows, _cut=masks.moved(F.col(mask), -own[0], -own[1], wide, tall), _w=wide, _h=tall, _nw=new_wide, _nh=new_tall)
    rows = computed(rows, _new=masks.resized(F.col("_cut"), *(F.col(c) for c in ("_w", "_h", "_nw", "_nh"))))
    placed = F.transform("_new", lambda r: F.struct((r["v"] + F.col("ry0")).alias("v"), (r["u0"] + F.col("rx0")).alias("u0"), (r["u1"] + F.col("rx0")).alias("u1")))
    return rows.withColumn(mask, placed).drop("_r", "_cut", "_new", "_w", "_h", "_nw", "_nh")


def in_masks(depth_pixels: DataFrame, mask_pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Depth pixels in each mask of their frame (mask_id): a pixel in two masks comes twice."""
    return depth_pixels.join(mask_pixels.select(*keys, "mask_id", "u", "v").hint("merge"), [*keys, "u", "v"])


def coloured_points(rows: DataFrame, depth: str, colours: str, width: int, height: int, focal: tuple[float, float], keys: list[str]) -> DataFrame:
    """Depth and colour rasters (array of structs r, g, b up to 255) of one row -> points with colours from 0 to 1, by pixel number.

    The principal point is the image's centre.
    """
    both = rows.select(*keys, F.posexplode(F.arrays_zip(F.col(depth).alias("z"), F.col(colours).alias("c"))).alias("p", "d"))
    pixel = both.select(*keys, (F.col("p") % width).alias("u"), F.floor(F.col("p") / width).cast("int").alias("v"), F.col("d.z").cast("double").alias("z"), *((F.col(f"d.c.{c}") / 255).alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))))
    return depth_points(pixel, (*focal, width / 2, height / 2))


#: Colours of compared clouds, from 0 to 1 (fixed values).
CLOUD_COLOURS = {"pseudo": (1.0, 0.0, 0.0), "measured": (0.117647, 0.564706, 1.0)}


def compared_clouds(pseudo: DataFrame, measured: DataFrame, keys: list[str], voxel: float | None = None, coloured: bool = False) -> DataFrame:
    """Both clouds (x, y, z) tagged with their source; with a voxel size, the mean points of each source's cells.

    coloured: with their sources' colours; then a voxel's points of both clouds are one cell of mean colour, with the number of each.
    """
    colour = lambda name: [F.lit(v).alias(c) for c, v in zip(("red", "green", "blue"), CLOUD_COLOURS[name], strict=True)]
    parts = [cloud.select(*keys, F.lit(name).alias("source"), "x", "y", "z", *(colour(name) if coloured else [])) for name, cloud in (("pseudo", pseudo), ("measured", measured))]
    both = parts[0].unionByName(parts[1])
    if voxel is None:
        return both
    if not coloured:
        return voxels(both, voxel, [*keys, "source"])
    cells = voxels(both.withColumn("_pseudo", (F.col("source") == "pseudo").cast("double")), voxel, keys, ("red", "green", "blue", "_pseudo"))
    n_pseudo = F.round(F.col("_pseudo") * F.col("n_points")).cast("long")
    return cells.withColumns({"n_pseudo": n_pseudo, "n_measured": F.col("n_points") - n_pseudo}).drop("_pseudo")
