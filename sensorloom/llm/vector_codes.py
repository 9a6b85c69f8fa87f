"""Vector compression by product codes, whose codebooks are trained with ball k-means on integers.

A vector's integers are cut into parts, and each part is named by the nearest entry of its position's codebook. After the
first round a part's entry owns a ball: its parts and their largest distance from it. An entry whose half distance from the
ball's centre exceeds that radius can take none of them; the others are its neighbours, nearest first. Parts within half the
nearest neighbour's distance are the stable core and keep their entry unseen. The rest lie in rings between the neighbours'
half distances, and are compared with the neighbours inside their ring only. All comparisons are of exact integers.

Rows stay in their tasks; a round moves sums of its entries (parts x entries x length numbers for each task), no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, on_workers, scratch, spread_join, stored

#: Rows that are assigned at a time.
BLOCK_ROWS = 8_192

_CODED = "vec_id long, group string, x array<long>, code array<short>, error long, part int, entry int, n long, total array<long>"


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, the first of equals, and its squared distance: every entry is tried."""
    best, code = None, np.zeros(len(x), np.int64)
    for k, entry in enumerate(entries):
        d = np.square(x - entry).sum(axis=1)
        if best is None:
            best = d
        else:
            nearer = d < best
            best = np.where(nearer, d, best)
            code[nearer] = k
    return code, best


def nearest_by_balls(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As nearest(), from entries (`code`) that rows had before the entries moved."""
    best, new = np.square(x - entries[code]).sum(axis=1), code.copy()
    gaps = np.square(entries[:, None] - entries[None]).sum(axis=2)  # of centres, squared
    order = np.argsort(code, kind="stable")
    ends = np.cumsum(np.bincount(code, minlength=len(entries)))
    for k in np.flatnonzero(np.diff(ends, prepend=0)):
        ball = order[ends[k - 1] if k else 0 : ends[k]]
        own = best[ball]
        gap = gaps[k].copy()
        gap[k] = np.iinfo(np.int64).max
        near = np.flatnonzero(gap <= 4 * own.max())  # half the gap is within the radius
        if not len(near):
            continue
        near = near[np.argsort(gap[near], kind="stable")]
        ring = np.searchsorted(gap[near], 4 * own, side="right")  # neighbours inside each part's ring; 0: stable core
        moving = ring > 0
        ball, ring = ball[moving], ring[moving]
        at = np.repeat(np.arange(len(ball)), ring)
        first = np.cumsum(ring) - ring
        other = near[np.arange(len(at)) - np.repeat(first, ring)]
        d = np.square(x[ball[at]] - entries[other]).sum(axis=1)
        least = np.minimum.reduceat(d, first) if len(first) else d[:0]
        tied = np.where(d == np.repeat(least, ring), other, len(entries))
        lowest = np.minimum.reduceat(tied, first) if len(first) else tied[:0]
        better = (least < best[ball]) | ((least == best[ball]) & (lowest < k))
        best[ball[better]], new[ball[better]] = least[better], lowest[better]
    return new, best


def bound(parts: int, length: int) -> int:
    """The largest integer component: errors of a row then fit 62 bits."""
    return max(1, (math.isqrt((1 << 62) // max(1, parts * length)) - 1) // 2)


def quantised(vectors: DataFrame, parts: int, scale: int, id_col: str, vec_col: str, group: Column) -> DataFrame:
    """vec_id, group, x: floor(scale * component) of the vectors that take part, stored; shorter vectors end in zeros."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), group.alias("group"), F.transform(F.col(vec_col), lambda e: e.cast("double")).alias("x"))
    rows = rows.where(F.col("x").isNotNull() & F.forall("x", finite))
    longest = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    length = max(1, -(-longest // parts))
    most = float(bound(parts, length))
    whole = F.transform("x", lambda e: F.floor(F.least(F.greatest(e * scale, F.lit(-most)), F.lit(most))).cast("long"))
    padded = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(parts * length) - F.size("x")))
    return stored(rows.withColumn("x", padded), "codes-rows")


def _assigned(rows: DataFrame, books: np.ndarray, coded: bool) -> DataFrame:
    """Rows with their codes and errors, and behind them, for each task, the sums of each entry's parts (`part` isn't null there)."""
    parts, entries, length = books.shape

    def table(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"vec_id": pa.int64(), "group": pa.string(), "x": pa.list_(pa.int64()), "code": pa.list_(pa.int16()), "error": pa.int64(), "part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "total": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, t) for c, t in kinds.items()], names=list(kinds))

    def lists(matrix: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1], pa.array(matrix.reshape(-1)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, length), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, parts, length)
                old = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, parts).astype(np.int64) if coded else None
                code, error = np.zeros((batch.num_rows, parts), np.int16), np.zeros(batch.num_rows, np.int64)
                for p in range(parts):
                    own = np.ascontiguousarray(x[:, p])
                    new, d = nearest_by_balls(own, books[p], old[:, p]) if coded else nearest(own, books[p])
                    code[:, p] = new
                    error += d
                    n[p] += np.bincount(new, minlength=entries)
                    np.add.at(total[p], new, own)
                yield table(batch.num_rows, vec_id=batch.column(0), group=batch.column(1), x=batch.column(2), code=lists(code), error=pa.array(error))
        p, e = np.nonzero(n)
        if len(p):
            yield table(len(p), part=pa.array(p.astype(np.int32)), entry=pa.array(e.astype(np.int32)), n=pa.array(n[p, e]), total=lists(total[p, e]))

    return rows.select("vec_id", "group", "x", *(["code"] if coded else [])).mapInArrow(assign, _CODED)


def moved(books: np.ndarray, coded: DataFrame) -> np.ndarray:
    """Entries at the floored means of their parts; unused ones stay. The driver gets one row an entry."""
    out = books.copy()
    length = books.shape[2]
    sums = coded.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(length)))
    for r in sums.collect():
        out[r.part, r.entry] = [int(r[f"s{j}"]) // r.n for j in range(length)]
    return out


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, length): the parts of the rows with the smallest ids (null first, equal ids by their vectors); fewer entries, if rows are fewer."""
    first = [r.x for r in rows.select("vec_id", "x").orderBy("vec_id", "x").limit(entries).collect()]
    if not first:
        return np.zeros((parts, 0, 1), np.int64)
    x = np.array(first, np.int64).reshape(len(first), parts, -1)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def train(rows: DataFrame, books: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """Rounds of assigning and moving, and a last assignment: (coded rows, stored; final books). What a round stored goes with the next."""
    coded, before = rows, None
    for k in range(rounds + 1):
        path = fresh_path(rows.sparkSession, f"codes-{k}")
        with scratch(rows.sparkSession) as paths:
            _assigned(coded if k == 0 else coded.where("part is null"), books, k > 0).write.parquet(path)
            paths += [before] if before else []
        coded, before = rows.sparkSession.read.schema(_CODED).parquet(path), path
        if k < rounds:
            books = moved(books, coded)
    return coded.where("part is null").drop("part", "entry", "n", "total"), books


def decoded(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """Adds x: the integers that codes (array of entry numbers) stand for. Books are parameters of the model, not of the data."""
    entries = F.array(*(F.array(*(F.array(*(F.lit(int(v)) for v in e)) for e in book)) for book in books))
    return codes.withColumn("x", F.flatten(F.zip_with(entries, F.col(code), lambda book, k: book[k.cast("int")])))


def books_digest(books: np.ndarray) -> str:
    """Lower-case hex SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(one row per vector: vec_id, code, error, label_error; the codebooks, parts x entries x length).

    code: entry numbers, one a part. error: squared distance from what the code stands for; label_error: its sum over the rows
    with the same label, nulls together (a sum beyond 64 bits is the largest such number). A component becomes
    floor(scale * x), bounded by about 2 ** 27 for 64 components (bound()), so that sums are exact. Vectors that are null or
    hold null or non-finite components take no part; shorter ones, and those whose length `parts` doesn't divide, end in
    zeros. Null ids come first and repeated ids are rows like others; equal distances go to the lower entry. Other columns
    are ignored. An empty table gives no rows and books without entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has 1 to 256 entries")
    on_workers(vectors.sparkSession)
    group = F.coalesce(F.concat(F.lit("g:"), F.col(label_col).cast("string")), F.lit("none"))
    rows = quantised(vectors, parts, scale, id_col, vec_col, group)
    books = first_books(rows, parts, entries)
    if not books.shape[1]:
        empty = rows.limit(0).select("vec_id", F.array().cast("array<short>").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")))
        return empty, books
    coded, books = train(rows, books, rounds)
    most = Decimal((1 << 63) - 1)
    sums = stored(coded.groupBy("group").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(most)).cast("long").alias("label_error")), "codes-sums")
    out = spread_join(coded.select("vec_id", "group", "code", "error"), sums, "group", "inner")
    return out.select("vec_id", "code", "error", "label_error"), books


def code_text(code: Column) -> Column:
    """Two hex digits an entry number."""
    return F.array_join(F.transform(code, lambda k: F.lpad(F.lower(F.hex(k.cast("long"))), 2, "0")), "")
