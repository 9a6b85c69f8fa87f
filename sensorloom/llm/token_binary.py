"""Token ids in binary files of patched frame-of-reference blocks.

A file holds, in this order: blocks of BLOCK ids, a document table, an index of block starts and a footer. A block is its
minimum, a bit width chosen so that PERCENTILE per cent of the block's differences from the minimum fit, the packed low
bits, and an exception list (place, high bits) for the others. All numbers are little-endian.

Documents are range-partitioned by id, so files in partition order hold ids in ascending document order. File names are new
for each task attempt: a lost or repeated task leaves at most a file that no row names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_uri, fresh_path, on_workers, partitions, stored
from .tokens import encoder, slices

MAGIC = b"PFR2"
BLOCK, PERCENTILE = 512, 95
_HEAD = struct.Struct("<IBH")  # minimum, width, number of exceptions
_FOOT = struct.Struct("<QQQQQQ4s")  # ids, documents, null ids among them, place of document table, place of index, blocks, magic
#: Ids that are encoded or decoded at a time.
AT_ONCE = BLOCK * 1024


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of the ids; only the last may be short (it is padded, the footer has the true number)."""
    short = -len(ids) % BLOCK
    table = np.concatenate([ids, np.full(short, ids[-1] if len(ids) else 0, ids.dtype)]).astype(np.int64).reshape(-1, BLOCK)
    low = table.min(axis=1)
    rest = table - low[:, None]
    at = min(BLOCK - 1, -(-BLOCK * PERCENTILE // 100) - 1)
    limit = np.partition(rest, at, axis=1)[:, at]
    width = np.ceil(np.log2(limit + 1)).astype(np.int64)
    over = rest >> width[:, None]
    out: list[bytes] = [b""] * len(table)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(rest[own].astype("<u4").view(np.uint8).reshape(len(own), BLOCK, 4), axis=2, count=int(w), bitorder="little") if w else np.empty((len(own), BLOCK, 0), np.uint8)
        packed = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
        for i, row in zip(own.tolist(), packed, strict=True):
            where = np.flatnonzero(over[i])
            out[i] = _HEAD.pack(int(low[i]), int(w), len(where)) + row.tobytes() + where.astype("<u2").tobytes() + over[i, where].astype("<u4").tobytes()
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of blocks that begin at the given places of data."""
    heads = [_HEAD.unpack_from(data, s) for s in starts.tolist()]
    width = np.array([h[1] for h in heads])
    out = np.empty((len(heads), BLOCK), np.int64)
    for w in np.unique(width):
        own, size = np.flatnonzero(width == w), int(w) * BLOCK // 8
        raw = np.frombuffer(b"".join(data[starts[i] + _HEAD.size : starts[i] + _HEAD.size + size] for i in own.tolist()), np.uint8).reshape(len(own), size)
        bits = np.zeros((len(own), BLOCK, 32), np.uint8)
        bits[:, :, : int(w)] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(own), BLOCK, int(w))
        out[own] = np.packbits(bits, axis=2, bitorder="little").reshape(len(own), -1).view("<u4")
    for i, (low, w, n) in enumerate(heads):
        if n:
            at = int(starts[i]) + _HEAD.size + w * BLOCK // 8
            out[i, np.frombuffer(data, "<u2", n, at)] += np.frombuffer(data, "<u4", n, at + 2 * n).astype(np.int64) << w
        out[i] += low
    return out.reshape(-1)


class FileWriter:
    """Appends documents' ids; holds AT_ONCE ids and a number or two for each document."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.out, self.at, self.held, self.n_held, self.n_ids = fs.open_output_stream(path), 0, [], 0, 0
        self.starts: list[int] = []
        self.docs, self.sizes, self.n_null = array("q"), array("q"), 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Null ids come first in a file."""
        self.n_null += doc_id is None
        self.docs.append(0 if doc_id is None else doc_id)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.n_held >= AT_ONCE:
            self._put(self.n_held - self.n_held % BLOCK)

    def _put(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        for a in range(0, n, AT_ONCE):
            blocks = encode_blocks(ids[a : min(n, a + AT_ONCE)])
            sizes = np.cumsum([0, *map(len, blocks)])
            self.starts += (sizes[:-1] + self.at).tolist()
            self.out.write(b"".join(blocks))
            self.at += int(sizes[-1])
        self.held, self.n_held = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> None:
        if self.n_held:
            self._put(self.n_held)
        table = np.array(self.docs, "<i8").tobytes() + np.array(self.sizes, "<i8").tobytes()
        index = np.array(self.starts, "<u8").tobytes()
        self.out.write(table + index + _FOOT.pack(self.n_ids, len(self.docs), self.n_null, self.at, self.at + len(table), len(self.starts), MAGIC))
        self.out.close()


def read_footer(fs: pafs.FileSystem, path: str) -> tuple[int, int, int, int, int, int]:
    """Numbers of ids, documents and null ids of a file, places of its document table and index, number of blocks."""
    with fs.open_input_file(path) as f:
        f.seek(f.size() - _FOOT.size)
        *numbers, magic = _FOOT.unpack(f.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a token file")
        return tuple(numbers)


def read_file(fs: pafs.FileSystem, path: str) -> Iterator[tuple[int | None, int, int]]:
    """(doc_id, number of ids, crc32 of the ids) of each document, from the file alone, a stretch of blocks at a time."""
    n_ids, n_docs, n_null, table_at, index_at, n_blocks = read_footer(fs, path)
    with fs.open_input_file(path) as f:
        f.seek(table_at)
        docs = np.frombuffer(f.read(index_at - table_at), "<i8").reshape(2, n_docs)
        starts = np.frombuffer(f.read(8 * n_blocks), "<u8").astype(np.int64)
        ends = np.append(starts[1:], table_at)
        per, left, block, seen = AT_ONCE // BLOCK, np.empty(0, "<u4"), 0, 0
        for k in range(n_docs):
            n = int(docs[1, k])
            crc, missing = 0, n
            while missing:
                if not len(left):
                    last = min(n_blocks, block + per) - 1
                    f.seek(int(starts[block]))
                    data = f.read(int(ends[last] - starts[block]))
                    left = decode_blocks(data, starts[block : last + 1] - starts[block]).astype("<u4")
                    block = last + 1
                    seen += len(left)
                    if seen > n_ids:
                        left = left[: len(left) - (seen - n_ids)]
                crc = zlib.crc32(left[:missing].tobytes(), crc)
                missing, left = missing - min(missing, len(left)), left[missing:]
            yield None if k < n_null else int(docs[0, k]), n, crc


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, white_space_counts: bool = True, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files below folder (a URI that all executors reach); returns part, path, n_docs, n_ids per file.

    Files in the order of part hold the documents by ascending id. Null ids come first; null and empty texts are the end id
    alone; rows that repeat an id stand together, in the order of a hash of their text (so they may go to several files).
    Other columns are ignored. An empty table gives no files.
    """
    on_workers(docs.sparkSession)
    fs, place = pafs.FileSystem.from_uri(folder)
    fs.create_dir(place)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path, white_space_counts), np.array([end_id], "<u4").tobytes()
        own_fs, top = pafs.FileSystem.from_uri(folder)
        part, out, path = TaskContext.get().partitionId(), None, ""
        for batch in batches:
            for some in slices(batch, 1):
                for doc, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1)), strict=True):
                    if out is None:
                        path = f"{top}/part-{part:06d}-{uuid.uuid4().hex}.pfor"
                        out = FileWriter(own_fs, path)
                    out.add(doc, ids + end)
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(out.docs)], pa.int64()), pa.array([out.n_ids], pa.int64())], names=["part", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    mixed = rows.withColumn("mix", F.xxhash64("text"))
    ordered = mixed.repartitionByRange(partitions(docs.sparkSession), "doc_id", "mix").sortWithinPartitions("doc_id", "mix", "text")
    return stored(ordered.select("doc_id", "text").mapInArrow(write, "part int, path string, n_docs long, n_ids long"), "token-files")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """Read token files (part, path) back: doc_id, start, n_tokens, ids_crc32 per document; start counts all ids before it.

    Everything but the files' order comes from the files: a first job reads their footers, for the ids before each file.
    Files without documents give no rows; a file that isn't one of these is an error.
    """

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            n_ids = [read_footer(own_fs, path)[0] for path in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n_ids, pa.int64())], names=["part", "path", "n_ids"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                for doc, n, crc in read_file(own_fs, path):
                    out.append((doc, start, n, crc))
                    start += n
                    if len(out) == 8192:
                        yield _read_batch(out)
                        out = []
                if out:
                    yield _read_batch(out)

    n = min(max(1, files.count()), 4 * partitions(files.sparkSession))
    sized = stored(files.select("part", "path").repartition(n, "part").mapInArrow(footers, "part int, path string, n_ids long"), "token-footers")
    # A row per file, so one small window gives the running start.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return placed.select("path", "start", "part").repartition(n, "part").select("path", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer_path: str, white_space_counts: bool = True, end_id: int = 0) -> DataFrame:
    """Write the documents' tokens and read them back: doc_id, start, n_tokens, ids_crc32."""
    folder = as_uri(fresh_path(docs.sparkSession, "tokens"))
    return read_tokens(write_tokens(docs, folder, tokenizer_path, white_space_counts, end_id), folder)
