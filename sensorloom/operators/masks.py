"""Masks as runs: for each row of pixels the stretches that are true. Nothing is exploded to pixels.

A mask is an array of runs (v, u0, u1): row, first column, end column (exclusive), in image order, disjoint and not touching.
Moving, cutting, resampling, measuring and testing work on runs; a mask's dense form exists only where someone asks for it.
An empty mask has no runs; null stays null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import on_workers

RUNS = "array<struct<v:int,u0:int,u1:int>>"


def _run(v: Column, u0: Column, u1: Column) -> Column:
    return F.struct(v.cast("int").alias("v"), u0.cast("int").alias("u0"), u1.cast("int").alias("u1"))


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), where c is computed once however often it is used: a lambda's variable isn't copied as an expression is."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _int(n: Column | int) -> Column:
    return n.cast("int") if isinstance(n, Column) else F.lit(n)


def encoded(bits: Column, width: Column | int) -> Column:
    """Runs of a row-major array of booleans; null pixels are false."""
    width = _int(width)

    def runs(bits: Column) -> Column:
        on = lambda p: F.coalesce(F.get(bits, p), F.lit(False))
        first = F.transform(bits, lambda b, p: F.when(b & ((p % width == 0) | ~on(p - 1)), p))
        last = F.transform(bits, lambda b, p: F.when(b & ((p % width == width - 1) | ~on(p + 1)), p))
        known = lambda ps: F.filter(ps, lambda p: p.isNotNull())
        return F.transform(F.arrays_zip(known(first).alias("a"), known(last).alias("b")), lambda z: _run(F.floor(z["a"] / width), z["a"] % width, z["b"] % width + 1))

    return _once(bits, runs)


def decoded(runs: Column, width: Column | int, height: Column | int) -> Column:
    """The row-major array of booleans."""
    width, height = _int(width), _int(height)

    def bits(runs: Column) -> Column:
        stop = lambda i: F.when(i == 0, 0).otherwise(F.get(runs, i - 1)["v"] * width + F.get(runs, i - 1)["u1"])
        body = F.flatten(F.transform(runs, lambda r, i: F.concat(F.array_repeat(F.lit(False), r["v"] * width + r["u0"] - stop(i)), F.array_repeat(F.lit(True), r["u1"] - r["u0"]))))
        return F.concat(body, F.array_repeat(F.lit(False), width * height - F.when(F.size(runs) == 0, 0).otherwise(stop(F.size(runs)))))

    return _once(runs, bits)


def places(runs: Column, width: Column | int) -> Column:
    """Row-major numbers of the true pixels."""
    return F.flatten(F.transform(runs, lambda r: F.sequence(r["v"] * _int(width) + r["u0"], r["v"] * _int(width) + r["u1"] - 1)))


def area(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + (r["u1"] - r["u0"]))


def region(runs: Column) -> Column:
    """Bounding rectangle (x0, y0, x1, y1; ends exclusive), null for an empty mask."""

    def box(runs: Column) -> Column:
        of = lambda f: F.transform(runs, f)
        ends = F.struct(F.array_min(of(lambda r: r["u0"])).alias("x0"), F.array_min(of(lambda r: r["v"])).alias("y0"), F.array_max(of(lambda r: r["u1"])).alias("x1"), (F.array_max(of(lambda r: r["v"])) + 1).alias("y1"))
        return F.when(F.size(runs) > 0, ends)

    return _once(runs, box)


def moved(runs: Column, dx: Column | int, dy: Column | int, width: Column | int, height: Column | int) -> Column:
    """Moved by (dx, dy) and cut to a canvas of that size: pastes a crop on its image, or cuts a crop out (with minus its corner)."""
    cut = F.transform(runs, lambda r: _run(r["v"] + _int(dy), F.greatest(r["u0"] + _int(dx), F.lit(0)), F.least(r["u1"] + _int(dx), _int(width))))
    return F.filter(cut, lambda r: (r["v"] >= 0) & (r["v"] < _int(height)) & (r["u0"] < r["u1"]))


def resized(runs: Column, width: Column | int, height: Column | int, new_width: Column | int, new_height: Column | int) -> Column:
    """Resampled to the nearest: pixel i of the new side takes int((i + 0.5) * old / new), so a run's new columns are one stretch again.

    Integers only: the first i that takes old pixel a or a later one is ceil(a * new / old - 1/2).
    """
    first = lambda a, old, new: F.floor((2 * a.cast("long") * _int(new) + _int(old) - 1) / (2 * _int(old))).cast("int")

    def rows(r: Column) -> Column:
        low, high = first(r["v"], height, new_height), first(r["v"] + 1, height, new_height)
        left, right = first(r["u0"], width, new_width), first(r["u1"], width, new_width)
        new = F.transform(F.sequence(low, F.greatest(high - 1, low)), lambda v: _run(v, left, right))
        return F.when((high > low) & (right > left), new).otherwise(F.array().cast(RUNS))

    # A row of old pixels may give several new rows, one behind the other for each run: back to image order.
    return _once(F.array_sort(F.flatten(F.transform(runs, rows))), _met)


def _met(runs: Column) -> Column:
    """Sorted disjoint runs, where those that touch become one."""
    apart = lambda a, b: a.isNull() | b.isNull() | (a["v"] != b["v"]) | (a["u1"] < b["u0"])
    first = F.filter(runs, lambda r, i: apart(F.get(runs, i - 1), r))
    last = F.filter(runs, lambda r, i: apart(r, F.get(runs, i + 1)))
    return F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda z: _run(z["a"]["v"], z["a"]["u0"], z["b"]["u1"]))


#: A run as one number that sorts as runs do: v, u0 and u1 of 21 bits each.
PART = 21


def _packed(runs: Column) -> Column:
    return F.transform(runs, lambda r: r["v"].cast("long") * (1 << 2 * PART) + r["u0"].cast("long") * (1 << PART) + r["u1"])


def _unpacked(numbers: Column) -> Column:
    part = lambda x, k: F.shiftright(x, k * PART).bitwiseAND(F.lit((1 << PART) - 1))
    return F.transform(numbers, lambda x: _run(part(x, 2), part(x, 1), part(x, 0)))


def _joined(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All values of a batch's arrays one behind the other, and the number of each one's row."""
    sizes = [0 if x is None else len(x) for x in column]
    parts = [np.asarray(x) for x in column if x is not None and len(x)]
    return np.concatenate(parts) if parts else np.array([], np.int64), np.repeat(np.arange(len(column)), sizes)


def united(rows: DataFrame, masks: Column, name: str) -> DataFrame:
    """Adds one mask of an array of masks: runs of a row that meet or overlap become one. Null masks count as empty, a null array stays null."""

    @F.pandas_udf("array<bigint>")
    def run(lists: pd.Series) -> pd.Series:
        flat, row = _joined(lists)
        order = np.lexsort((flat, row))
        flat, row = flat[order], row[order]
        low = (1 << PART) - 1
        v, u0, u1 = flat >> 2 * PART, (flat >> PART) & low, flat & low
        change = np.append(True, (row[1:] != row[:-1]) | (v[1:] != v[:-1]))[: len(row)]
        shift = np.cumsum(change) << PART + 1  # ends of one row never reach the next
        reach = np.maximum.accumulate(u1 + shift) if len(row) else u1
        at = np.flatnonzero(np.append(True, u0[1:] + shift[1:] > reach[:-1])[: len(row)])
        stop = (reach - shift)[np.append(at[1:], len(row))[: len(at)] - 1] if len(at) else at
        out = (v[at] << 2 * PART) + (u0[at] << PART) + stop
        cuts = np.searchsorted(row[at], np.arange(len(lists) + 1))
        return pd.Series([None if x is None else out[cuts[i] : cuts[i + 1]] for i, x in enumerate(lists)], dtype=object)

    on_workers(rows.sparkSession)
    numbers = F.flatten(F.transform(F.filter(masks, lambda m: m.isNotNull()), _packed))
    flat = rows.withColumn("_flat", run.asNondeterministic()(numbers))  # so that it isn't copied into what reads it
    return flat.withColumn(name, _unpacked(F.col("_flat"))).drop("_flat")


def holds(runs: Column, points: Column) -> Column:
    """For each of an array of points (x, y), whether its pixel is in the mask: a binary search among all runs of a batch.

    A point's pixel is its coordinates cut down to whole numbers. Null where mask or points are null.
    """

    @F.pandas_udf("array<boolean>")
    def run(masks: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        flat, row = _joined(masks)
        x, of = _joined(xs)
        y, _ = _joined(ys)
        x, y = x.astype(float), y.astype(float)
        inside = np.isfinite(x) & np.isfinite(y) & (x >= 0) & (y >= 0) & (x < 1 << PART) & (y < 1 << PART)
        x, y = (np.where(inside, np.floor(np.where(inside, c, 0)), 0).astype(np.int64) for c in (x, y))
        low = (1 << PART) - 1
        # Rows and places have ranks of their own, so that both fit one number to search by.
        place = (flat >> PART, (y << PART) + x)
        known = np.unique(np.concatenate(place))
        rank = lambda p: np.searchsorted(known, p)
        at = np.searchsorted(row * (len(known) + 1) + rank(place[0]), of * (len(known) + 1) + rank(place[1]), side="right") - 1
        near = np.maximum(at, 0)
        found = inside & (at >= 0)
        if len(flat):
            found &= (row[near] == of) & (flat[near] >> 2 * PART == y) & (x < (flat[near] & low))
        ends = np.cumsum([0 if p is None else len(p) for p in xs])
        return pd.Series([None if m is None or p is None else found[e - len(p) : e] for m, p, e in zip(masks, xs, ends, strict=True)], dtype=object)

    on_workers(SparkSession.active())
    return run(_packed(runs), F.transform(points, lambda p: p["x"].cast("double")), F.transform(points, lambda p: p["y"].cast("double")))


def text(runs: Column) -> Column:
    """Runs as text, v:u0-u1 and a blank between: equal for equal masks only."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["v"].cast("string"), F.lit(":"), r["u0"].cast("string"), F.lit("-"), r["u1"].cast("string"))), " ")
