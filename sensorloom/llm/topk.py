"""Exact top-k inner-product search with a bit-sliced index.

Vectors are quantised to integers, dealt evenly into blocks of rows and stored as bitmaps: one per component and bit. A query
adds the slices of the components' high bits with bitmap arithmetic (carry-save adders), which gives every row's lower bound
as a bit-sliced number; the low bits that were left out add at most a known amount. Top rows are picked from the most
significant slice downward, and every row within reach of the boundary is settled by its exact integer score, from the same
slices. Ties go to the smaller id.

Blocks stay where they are; each task holds one block at a time and streams the stored queries past it. Integers too large
for 64-bit sums are in blocks of their own and counted without a limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_uri, fresh_path, on_workers, partitions, stored

#: A block ends at so many rows, or so many bytes of vectors; queries are read so many at a time.
BLOCK_ROWS, BLOCK_BYTES, QUERY_ROWS = 16_384, 32 << 20, 1024
#: Low bits of a component that the slices' sum leaves to the exact step.
DROP_BITS = 3

_INDEX = "block long, n_rows int, dims int, bits int, low string, ids binary, slices binary"
_FOUND = "query_id long, vec_id long, score long, beyond binary"


def _padded(column: pa.ListArray) -> np.ndarray:
    """Vectors as a matrix; shorter ones end in zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _integers(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of each component, and which rows are too large for 64-bit inner products (zeros in the first)."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    wide = np.abs(y).max(axis=1, initial=0) > math.isqrt((1 << 60) // max(1, x.shape[1]))
    return np.where(wide[:, None], 0, y).astype(np.int64), wide


def _large_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) without a limit, as Python numbers."""
    one = lambda v: int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale)
    return np.array([[one(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


class SlicedBlock:
    """Bit slices of some integer vectors, in ascending id order: slices[d, s] is bit s of component d, a bit per row."""

    def __init__(self, ids: np.ndarray, slices: np.ndarray, low: int) -> None:
        self.ids, self.all_slices, self.low, self.n = ids, slices, low, len(ids)
        self.drop = min(DROP_BITS, max(0, slices.shape[1] - 1))
        self.bits = slices.shape[1] - self.drop
        self.slices = np.ascontiguousarray(slices[:, self.drop :])
        self.present = self._pack(np.ones((1, self.n), np.uint8))[0]
        self.inverse = ~self.slices
        self._values: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> SlicedBlock:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        low = int(values.min()) if values.size else 0
        spread = np.ascontiguousarray((values - low).T)
        bits = int(spread.max()).bit_length() if spread.size else 0
        words = -(-len(ids) // 64)
        slices = np.stack([cls._pack((spread >> s) & 1) for s in range(bits)], axis=1) if bits else np.empty((spread.shape[0], 0, words), np.uint64)
        return cls(ids, slices, low)

    @property
    def values(self) -> np.ndarray:
        """The exact integers, from the slices; Python numbers where they are large."""
        if self._values is None:
            bits = self.all_slices.shape[1]
            out = np.zeros((self.n, self.all_slices.shape[0]), np.int64 if bits < 62 and abs(self.low) < 1 << 62 else object)
            for s in range(bits):
                own = np.unpackbits(np.ascontiguousarray(self.all_slices[:, s]).view(np.uint8), axis=1, count=self.n, bitorder="little")
                out += own.T.astype(out.dtype) << s
            self._values = out + self.low
        return self._values

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        raw = np.packbits(bits.astype(np.uint8), axis=-1, bitorder="little")
        pad = -raw.shape[-1] % 8
        return np.pad(raw, [(0, 0)] * (raw.ndim - 1) + [(0, pad)]).view(np.uint64)

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices (least significant first) of sum |q_d| * z_d, where z is the high part, or its complement where q_d < 0; and what that complement adds."""
        size = np.abs(q)
        columns: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max()).bit_length() if len(size) else 0):
            has = ((size >> j) & 1 == 1).astype(bool)
            for source, own in ((self.slices, has & (q > 0).astype(bool)), (self.inverse, has & (q < 0).astype(bool))):
                if own.any():
                    picked = source[own]
                    for s in range(self.bits):
                        columns.setdefault(j + s, []).append(picked[:, s])
        out: list[np.ndarray] = []
        w = 0
        while columns:
            parts = columns.pop(w, None)
            if parts is None:
                out.append(np.zeros_like(self.present))
                w += 1
                continue
            rows = np.concatenate(parts)
            while len(rows) > 1:
                k = len(rows) // 3
                if k:
                    a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
                    x = a ^ b
                    carry = (a & b) | (x & c)
                    rows = np.concatenate([x ^ c, rows[3 * k :]])
                else:
                    carry = rows[:1] & rows[1:]
                    rows = rows[:1] ^ rows[1:]
                columns.setdefault(w + 1, []).append(carry)
            out.append(rows[0] & self.present)
            w += 1
        return out, int(size[(q < 0).astype(bool)].sum()) * ((1 << self.bits) - 1)

    def top(self, q: np.ndarray, k: int, own_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows but those with own_id, best first."""
        valid = self.present.copy()
        for i in range(int(np.searchsorted(self.ids, own_id)), int(np.searchsorted(self.ids, own_id, "right"))):
            valid[i >> 6] &= ~np.uint64(1 << (i & 63))
        n_valid = int(np.bitwise_count(valid).sum())
        if n_valid > k:
            slices, offset = self.sums(q)
            sure, even = np.zeros_like(valid), valid
            for s in reversed(slices):  # most significant slice first
                with_bit = even & s
                n = int(np.bitwise_count(sure | with_bit).sum())
                if n >= k:
                    even = with_bit
                else:
                    sure = sure | with_bit
                    even = even & ~s
            some = self._rows(sure | even)[: 4 * k]  # k rows at least have this lower bound
            # Exact scores of k such rows bound the k-th best score from below.
            reach = ((1 << self.drop) - 1) * int(np.abs(q).sum())
            base = int(q.sum()) * self.low + int(q[(q < 0).astype(bool)].sum()) * ((1 << self.drop) - 1) - (offset << self.drop)
            least = np.sort(self._scores(some, q))[-k]
            want = -((base + reach - int(least)) >> self.drop)  # the smallest sum that can still reach `least`
            rows = self._rows(self._at_least(slices, want, valid))
        else:
            rows = self._rows(valid)
        scores = self._scores(rows, q)
        if len(rows) > k:
            keep = (scores >= np.sort(scores)[len(rows) - k]).astype(bool)
            rows, scores = rows[keep], scores[keep]
        order = np.lexsort((self.ids[rows], -scores))[:k] if scores.dtype != object else sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
        return self.ids[rows[order]], scores[order]

    def _scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        own = self.values[rows]
        return own @ q if own.dtype == q.dtype else own.astype(object) @ q.astype(object)

    def _at_least(self, slices: list[np.ndarray], least: int, valid: np.ndarray) -> np.ndarray:
        if least <= 0:
            return valid
        if least >> len(slices):
            return np.zeros_like(valid)
        above, even = np.zeros_like(valid), valid
        for i in range(len(slices) - 1, -1, -1):
            if (least >> i) & 1:
                even = even & slices[i]
            else:
                above = above | (even & slices[i])
                even = even & ~slices[i]
        return above | even

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(len(words), 64)
        at, bit = np.nonzero(bits)
        return words[at] * 64 + bit


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, x array<double>. Vectors that are null, or hold null or non-finite components, and null ids take no part."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(F.forall("x", finite))


def build_index(rows: DataFrame, scale: int) -> DataFrame:
    """Rows (vec_id, x) -> one row per block: its ids, its slices and what they need to be read.

    Rows are dealt in turn, so neither repeated ids nor repeated vectors make a block large. Vectors of one block end in
    zeros where they are shorter than others.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n, size = TaskContext.get().partitionId() << 32, [], 0, 0

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal number
            own = pa.Table.from_batches(held).combine_chunks()
            ids, x = own.column(0).to_numpy(), _padded(own.column(1).combine_chunks())
            values, wide = _integers(x, scale)
            for some, ints in ((~wide, values), (wide, None)):
                if some.any():
                    b = SlicedBlock.of(ids[some], ints[some] if ints is not None else _large_integers(x[some], scale))
                    dims, bits, _ = b.all_slices.shape
                    cols = [pa.array([number]), pa.array([b.n], pa.int32()), pa.array([dims], pa.int32()), pa.array([bits], pa.int32()), pa.array([str(b.low)]), pa.array([b.ids.astype("<i8").tobytes()], pa.binary()), pa.array([b.all_slices.astype("<u8").tobytes()], pa.binary())]
                    yield pa.record_batch(cols, names=["block", "n_rows", "dims", "bits", "low", "ids", "slices"])
                    number += 1

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                longest = _longest(part)
                if held and (n + part.num_rows > BLOCK_ROWS or 8 * max(size, longest) * (n + part.num_rows) > BLOCK_BYTES):
                    yield from blocks()
                    held, n, size = [], 0, 0
                held.append(part)
                n, size = n + part.num_rows, max(size, longest)
        if held:
            yield from blocks()

    n, components = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("x")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ROWS), -(-8 * components // BLOCK_BYTES))
    return rows.repartition(parts).mapInArrow(build, _INDEX)


def _longest(batch: pa.RecordBatch) -> int:
    return int(np.diff(batch.column(1).offsets.to_numpy()).max(initial=0))


def _sortable(score: int) -> tuple[int, bytes]:
    """A score as a 64-bit number (the nearest, if it is larger), and bytes that put larger ones in order."""
    if -(1 << 63) < score < 1 << 63:
        return score, b""
    size = abs(score).bit_length() // 8 + 1
    raw = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return ((1 << 63) - 1, raw) if score > 0 else (-(1 << 63), bytes(255 - b for b in raw))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k highest integer inner products with all other rows.

    All rows, if there are fewer. Rows that repeat a query's id aren't its partners, and such ids are one query (its smallest
    vector). Of vectors of different lengths the shorter counts as ending in zeros. Integers have no limit; a score beyond 64
    bits ranks by its true value and comes back as the nearest 64-bit number. Rows whose vector is null, or holds null or
    non-finite components, and null ids take no part. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    on_workers(spark)
    rows = stored(usable(vectors, id_col, vec_col), "topk-rows")
    index = stored(build_index(rows, scale), "topk-index")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    queries = as_uri(fresh_path(spark, "topk-queries"))
    asked.write.parquet(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = pafs.FileSystem.from_uri(queries)
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(place)) if f.path.endswith(".parquet"))
        for batch in batches:
            for i in range(batch.num_rows):
                dims, bits = batch.column("dims")[i].as_py(), batch.column("bits")[i].as_py()
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), "<i8")
                slices = np.frombuffer(batch.column("slices")[i].as_buffer(), "<u8").reshape(dims, bits, -(-len(ids) // 64))
                block = SlicedBlock(ids, slices, int(batch.column("low")[i].as_py()))
                for file in files:
                    with fs.open_input_file(file) as f:
                        for own in pq.ParquetFile(f).iter_batches(QUERY_ROWS, columns=["vec_id", "x"]):
                            yield _answers(block, own.column(0).to_numpy(), _padded(own.column(1)), dims, k, scale)

    # Blocks are few and even; more partitions than blocks keep them apart.
    n_blocks = max(1, index.count())
    dealt = index.repartition(min(4 * n_blocks, max(n_blocks, 2 * partitions(spark))), "block")
    best = dealt.mapInArrow(search, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(block: SlicedBlock, q_ids: np.ndarray, x: np.ndarray, dims: int, k: int, scale: int) -> pa.RecordBatch:
    """Each query's k best rows of a block. Components that the block's vectors don't have meet zeros."""
    x = x[:, :dims] if x.shape[1] >= dims else np.pad(x, [(0, 0), (0, dims - x.shape[1])])
    values, wide = _integers(x, scale)
    asked, found, scores = [], [], []
    for n, q_id in enumerate(q_ids.tolist()):
        own, own_scores = block.top(values[n] if not wide[n] else _large_integers(x[n : n + 1], scale)[0], k, q_id)
        asked += [q_id] * len(own)
        found += own.tolist()
        scores += own_scores.tolist()
    pairs = [_sortable(s) for s in scores]
    return pa.record_batch([pa.array(asked, pa.int64()), pa.array(found, pa.int64()), pa.array([s for s, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.binary())], names=["query_id", "vec_id", "score", "beyond"])
