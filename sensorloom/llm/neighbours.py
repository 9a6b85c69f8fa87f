"""Approximate nearest neighbours by inner product, with multi-index hashing of learned rotated binary codes.

Vectors get one more component that brings them to one norm, so inner products rank as distances do. Their principal
components are rotated until signs lose least (learnt from a bounded sample), and the signs are the code. Codes are cut into
substrings of 16 bits, each with an index of its own in every block of rows. If a code lies within radius r of a query's, then
in some substring it lies within that substring's share of the radius (the shares sum to r - substrings + 1), so probing
every index retrieves every code within r; those are ranked by their exact inner products.

The radius is learnt too: the true neighbours of a bounded sample of queries are found by brute force over all rows, and r
is the least that holds the wanted share of them. Queries with fewer codes within r than they ask for are searched without it.

Blocks stay where they are; each task holds one block at a time and streams the stored queries past it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_uri, fresh_path, on_workers, partitions, stored
from .topk import usable

#: A block ends at so many rows, or so many bytes of vectors; queries are read so many at a time.
BLOCK_ROWS, BLOCK_BYTES, QUERY_ROWS = 16_384, 32 << 20, 1_024
#: Vectors that codes are learnt from (at most, and at most so many bytes), and queries that the radius is learnt from.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_QUERIES = 10_000, 64 << 20, 200
BITS, SUBSTRING, ROTATIONS = 128, 16, 20

_INDEX = "block long, n_rows int, ids binary, x binary, codes binary, orders binary"
_FOUND = "query_id long, vec_id long, score double, hamming int"


@dataclass
class Coder:
    """x -> sign of ((x / scale, rest) - mean) @ axes, where rest brings all vectors to one norm."""

    scale: float
    norm: float
    mean: np.ndarray
    axes: np.ndarray

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.axes > 0, axis=1, bitorder="little").view(np.uint64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self._codes(lifted(x / self.scale, self.norm))

    def queries(self, q: np.ndarray) -> np.ndarray:
        """Queries point into the space of rows with their norm: their own length changes no ranking."""
        q = q / np.abs(q).max(axis=1, keepdims=True)
        q = q * (self.norm / np.linalg.norm(q, axis=1, keepdims=True))
        return self._codes(np.pad(q, [(0, 0), (0, 1)]))


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm * norm - np.square(x).sum(axis=1), 0.0))
    return np.concatenate([x, rest[:, None]], axis=1)


def learnt(sample: np.ndarray, scale: float, norm: float, bits: int = BITS, seed: int = 5) -> Coder:
    """Principal axes, rotated so that signs are as near to the projections as they get; more such rotations where bits are more than axes."""
    x = lifted(sample / scale, norm)
    mean = x.mean(axis=0)
    x = x - mean
    _, vectors = np.linalg.eigh(x.T @ x)
    axes = vectors[:, ::-1][:, :bits]
    v = x @ axes
    rng, out = np.random.default_rng(seed), []
    while sum(a.shape[1] for a in out) < bits:
        turn, _ = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))
        for _ in range(ROTATIONS):
            left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = right.T @ left.T
        out.append(axes @ turn)
    return Coder(scale, norm, mean, np.concatenate(out, axis=1)[:, :bits])


#: All 16-bit numbers with their ones, fewest first, and how many have at most so many.
_ONES = np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint16))
_MASKS = np.argsort(_ONES, kind="stable").astype(np.uint16)
_WITHIN = np.cumsum(np.bincount(_ONES, minlength=SUBSTRING + 1))


class CodeBlock:
    """Rows with their codes and an index for each substring: the rows in the order of its values."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, orders: np.ndarray) -> None:
        self.ids, self.x, self.codes, self.orders = ids, x, codes, orders
        parts = codes.view(np.uint16)
        self.values, self.starts = [], []
        for t, order in enumerate(orders):
            values, first = np.unique(parts[order, t], return_index=True)
            self.values.append(values)
            self.starts.append(np.append(first, len(ids)))

    @staticmethod
    def orders_of(codes: np.ndarray) -> np.ndarray:
        return np.argsort(codes.view(np.uint16).T, axis=1, kind="stable").astype(np.int32)

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows whose code differs in at most `radius` bits, and in how many."""
        seen = np.zeros(len(self.ids), bool)
        parts = code.view(np.uint16)
        share, more = divmod(radius - len(parts) + 1, len(parts))
        for t, (values, starts, order) in enumerate(zip(self.values, self.starts, self.orders, strict=True)):
            r = min(SUBSTRING, share + (t < more))
            if r < 0:
                continue
            if _WITHIN[r] < len(values) // 8:  # fewer probes than buckets
                probes = np.sort(_MASKS[: _WITHIN[r]] ^ parts[t])
                at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
                buckets = at[values[at] == probes]
            else:
                buckets = np.flatnonzero(np.bitwise_count(values ^ parts[t]) <= r)
            sizes = starts[buckets + 1] - starts[buckets]
            ends = np.cumsum(sizes)
            if len(ends):
                seen[order[np.arange(ends[-1]) + np.repeat(starts[buckets] - ends + sizes, sizes)]] = True
        rows = np.flatnonzero(seen)
        far = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1)
        near = far <= radius
        return rows[near], far[near]

    def best(self, rows: np.ndarray, q: np.ndarray, k: int, own_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Of some rows, the k with the largest inner products and no own_id, and those, component by component."""
        rows = rows[self.ids[rows] != own_id]
        with np.errstate(over="ignore", invalid="ignore"):
            if len(rows) > k:
                rough = np.nan_to_num(self.x[rows] @ q, nan=-np.inf)
                least = np.partition(rough, len(rows) - k)[len(rows) - k]
                slack = 1e-9 * np.abs(q).max() * np.abs(self.x[rows]).sum(axis=1).max()  # more than any order of adding makes
                rows = rows[rough >= least - (slack if np.isfinite(slack) else np.inf)]
            score = np.zeros(len(rows))
            for j in range(len(q)):
                score += self.x[rows, j] * q[j]
        score = np.nan_to_num(score, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        order = np.lexsort((self.ids[rows], -score))[:k]
        return rows[order], score[order]


def _blocks(batch: pa.RecordBatch) -> Iterator[CodeBlock]:
    for i in range(batch.num_rows):
        raw = {c: batch.column(c)[i].as_buffer() for c in ("ids", "x", "codes", "orders")}
        n = batch.column("n_rows")[i].as_py()
        yield CodeBlock(np.frombuffer(raw["ids"], "<i8"), np.frombuffer(raw["x"], "<f8").reshape(n, -1), np.frombuffer(raw["codes"], "<u8").reshape(n, -1), np.frombuffer(raw["orders"], "<i4").reshape(-1, n))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _found(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(query id, ids, scores, distances) of some queries as a batch."""
    ids = np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts])
    join = lambda j, kind: pa.array(np.concatenate([p[j] for p in parts]).astype(kind) if parts else np.array([], kind))
    return pa.record_batch([pa.array(ids), join(1, np.int64), join(2, np.float64), join(3, np.int32)], names=["query_id", "vec_id", "score", "hamming"])


def build_index(rows: DataFrame, coder: Coder, dims: int) -> DataFrame:
    """Rows (vec_id, x) -> one row per block. Rows are dealt in turn, so repeated vectors and ids spread."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            own = pa.Table.from_batches(held).combine_chunks()
            x = np.concatenate([_matrix(c) for c in own.column(1).chunks])
            codes = coder.rows(x)
            raw = (own.column(0).to_numpy().astype("<i8"), x.astype("<f8"), codes.astype("<u8"), CodeBlock.orders_of(codes).astype("<i4"))
            return pa.record_batch([pa.array([number]), pa.array([len(x)], pa.int32()), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in raw)], names=["block", "n_rows", "ids", "x", "codes", "orders"])

        most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dims)))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if held and n + part.num_rows > most:
                    yield block()
                    held, n, number = [], 0, number + 1
                held.append(part)
                n += part.num_rows
        if held:
            yield block()

    parts = max(1, -(-rows.count() // BLOCK_ROWS), -(-rows.count() * 8 * dims // BLOCK_BYTES))
    return rows.select("vec_id", "x").repartition(parts).mapInArrow(build, _INDEX)


def _true_neighbours(index: DataFrame, ids: np.ndarray, q: np.ndarray, coder: Coder, k: int) -> DataFrame:
    """The k best of all rows for a few queries, by brute force, with their codes' distances."""
    codes = coder.queries(q)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                out = []
                for own, v, code in zip(ids.tolist(), q, codes, strict=True):
                    rows, score = block.best(np.arange(len(block.ids)), v, k, own)
                    out.append((own, block.ids[rows], score, np.bitwise_count(block.codes[rows] ^ code).sum(axis=1)))
                yield _found(out)

    return _ranked(index.mapInArrow(search, _FOUND), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _searched(index: DataFrame, queries: str, n_blocks: int, coder: Coder, k: int, radius: int) -> DataFrame:
    """Each query's k best of the codes within radius, block by block, then of all blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = pafs.FileSystem.from_uri(queries)
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(place)) if f.path.endswith(".parquet"))
        for batch in batches:
            for block in _blocks(batch):
                for file in files:
                    with fs.open_input_file(file) as f:
                        for own in pq.ParquetFile(f).iter_batches(QUERY_ROWS, columns=["vec_id", "x"]):
                            q, out = _matrix(own.column(1)), []
                            for query, v, code in zip(own.column(0).to_pylist(), q, coder.queries(q), strict=True):
                                rows, far = block.within(code, radius)
                                best, score = block.best(rows, v, k, query)
                                out.append((query, block.ids[best], score, far[np.searchsorted(rows, best)]))
                            yield _found(out)

    dealt = index.repartition(min(4 * n_blocks, max(n_blocks, 2 * partitions(index.sparkSession))), "block")
    return _ranked(dealt.mapInArrow(search, _FOUND), k)


def _sampled(rows: DataFrame, n_rows: int, wanted: int, salt: int) -> np.ndarray:
    """About `wanted` rows (vec_id, x) by a hash of the row, at most that many: (ids, vectors). All rows alike give some of them."""
    share = min(1.0, 1.1 * wanted / max(1, n_rows))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", "x", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(wanted)
    got = picked.select("vec_id", "x").toArrow() if share < 1 else rows.select("vec_id", "x").limit(wanted).toArrow()
    if not got.num_rows:
        got = rows.select("vec_id", "x").limit(wanted).toArrow()
    return got.column(0).to_numpy(), np.concatenate([_matrix(c) for c in got.column(1).chunks]) if got.num_rows else np.zeros((0, 0))


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.95, bits: int = BITS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest found among all other rows.

    Nearness is the inner product in double precision, added component by component; the score is exactly that. Ties go to
    the smaller id. recall is the share of true neighbours that the radius holds in the sample it is learnt from; a query
    gets k rows, or all, if there are fewer. Rows that repeat a query's id aren't its partners, and such ids are one query
    (its smallest vector). Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids;
    shorter vectors end in zeros. An inner product beyond the doubles is infinite. Other columns are ignored. An empty table
    gives no rows.
    """
    if bits % 64 or bits < 64:
        raise ValueError("codes have a multiple of 64 bits")
    spark = vectors.sparkSession
    on_workers(spark)
    rows = usable(vectors, id_col, vec_col).where(F.exists("x", lambda e: e != 0))
    dims = rows.agg(F.max(F.size("x"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stored(rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("x")))), "near-rows")
    n, scale = rows.agg(F.count("*"), F.max(F.array_max(F.transform("x", F.abs)))).first()
    norm = rows.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + (e / scale) * (e / scale))))).first()[0]
    _, sample = _sampled(rows, n, max(100, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims))), 1)
    coder = learnt(sample, scale, norm, bits)
    index = stored(build_index(rows, coder, dims), "near-index")
    n_blocks = index.count()

    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"), F.count("*").alias("own"))
    queries = as_uri(fresh_path(spark, "near-queries"))
    asked.write.parquet(queries)
    asked = spark.read.parquet(queries)
    ids, q = _sampled(asked, asked.count(), SAMPLE_QUERIES, 2)
    if not len(ids):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    distances = sorted(r.hamming for r in _true_neighbours(index, ids, q, coder, k).select("hamming").collect())
    radius = distances[min(len(distances) - 1, int(recall * len(distances)))] if distances else bits

    found = stored(_searched(index, queries, n_blocks, coder, k, radius), "near-found")
    counts = asked.select("vec_id", "x", "own").join(found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("got")).hint("merge"), "vec_id", "left")
    few = as_uri(fresh_path(spark, "near-few"))
    counts.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.lit(n) - F.col("own"))).select("vec_id", "x").write.parquet(few)
    short = spark.read.parquet(few)
    if radius < bits and not short.isEmpty():
        again = _searched(index, few, n_blocks, coder, k, bits)
        found = found.join(short.select(F.col("vec_id").alias("query_id")).hint("merge"), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")
