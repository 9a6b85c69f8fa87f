"""Integrity of records: references that must exist, and constraints on boxes and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(rows: DataFrame, flags: dict[str, tuple[str, str]], named: str, keep: bool = False) -> DataFrame:
    """Rows of left joins, whose flags must be true: a null one is an error with what is missing, its key and the row's name.

    Flags go, but if they are kept: then they are columns of the joined table that are never null there.

    The condition counts as one that depends on the partition, so Catalyst moves no other filter below it: a later one on a joined column would turn
    the left join into an inner one, and rows without a partner would go unseen.
    """
    problem = F.concat_ws("; ", *(F.when(F.col(flag).isNull(), F.concat(F.lit(f"no {what} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))) for flag, (what, key) in flags.items()))
    text = F.concat(F.lit("record "), F.coalesce(F.col(named).cast("string"), F.lit("null")), F.lit(" has "), problem)
    held = F.when(problem == "", F.spark_partition_id() >= 0).otherwise(F.raise_error(text).cast("boolean"))
    return rows.where(held) if keep else rows.where(held).drop(*flags)


def box_problems(x0: Column, y0: Column, x1: Column, y1: Column) -> list[tuple[str, Column]]:
    """Constraints of a 2-D box: four finite numbers. True where broken."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return [("a box has four finite coordinates", bad(x0) | bad(y0) | bad(x1) | bad(y1))]


def instance_problems(mask: Column, width: Column, height: Column, region: Column) -> list[tuple[str, Column]]:
    """Constraints of an instance: mask and region (x0, y0, x1, y1; ends exclusive) come together, the region holds something, and the mask is of its size."""
    there = mask.isNotNull() & region.isNotNull()
    wide, high = region["x1"] - region["x0"], region["y1"] - region["y0"]
    return [
        ("mask and region come together", mask.isNull() != region.isNull()),
        ("a region ends behind its start", F.coalesce(there & ((wide <= 0) | (high <= 0)), F.lit(False))),
        ("a mask has its region's width and height", F.coalesce(there & ((width != wide) | (height != high)), F.lit(False))),
        ("a mask has a bit for each pixel", F.coalesce(mask.isNotNull() & (F.size(mask) != width * height), F.lit(False))),
    ]


def checked(rows: DataFrame, problems: list[tuple[str, Column]], reasons: str = "reasons") -> DataFrame:
    """Rows with the list of constraints that they break (empty for good ones), evaluated once: filters above don't repeat it."""
    broken = F.filter(F.array(*(F.when(c, F.lit(text)) for text, c in problems)), lambda t: t.isNotNull())
    return rows.select("*", F.inline(F.array(F.struct(broken.alias(reasons)))))


def split(rows: DataFrame, problems: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(good rows as they were, bad rows with their reasons). Store checked() first, where both are written."""
    all_rows = checked(rows, problems)
    return all_rows.where(F.size("reasons") == 0).drop("reasons"), all_rows.where(F.size("reasons") > 0)
