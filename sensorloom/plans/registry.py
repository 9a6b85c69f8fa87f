"""Where queries register themselves: name -> query, and name -> SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Fixtures, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the derived tables under an inventory id and short name."""

    def add(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = duck(sql)
        return f

    return add


def nearest(c: Column | str, places: int) -> Column:
    """Rounded half away from zero by a scale, as DuckDB does, in generated code; F.round goes through decimal text, seven times as slow."""
    x = F.col(c) if isinstance(c, str) else c
    scaled = F.abs(x) * float(10**places)
    return F.when(scaled < 4e15, F.floor(scaled + 0.5) / float(10**places) * F.signum(x)).otherwise(F.round(x, places))


def r6(c: Column | str) -> Column:
    """Rounded to six places, without a negative zero."""
    return nearest(c, 6) + F.lit(0.0)


def rounded(**columns: Column | str) -> list[Column]:
    return [r6(c).alias(n) for n, c in columns.items()]
