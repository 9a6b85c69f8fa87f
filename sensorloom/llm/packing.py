"""Best-two-fit packing of tokenised documents into sequences.

Documents are cut only where longer than a sequence. Pieces (narrow rows) are stored, then dealt evenly to shards of about
SHARD_PIECES by a hash of their place in the stored order, so equal rows spread too; each shard is packed on its own, so its
last sequences are all that sharding can waste.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, stored
from .tokens import encoder, slices

#: Pieces per shard, about.
SHARD_PIECES = 25_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long"


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length (1..size), and the number of bins.

    A bin is filled greedily, largest piece that fits first. Then its smallest piece gives way to the two unpacked pieces
    that fill the widened gap best, if they fill it better. Works on counts per length, so each bin costs O(size) at most.
    """
    count = np.bincount(lengths, minlength=size + 1)
    numbers = np.arange(size + 1)
    at_most = np.maximum.accumulate(np.where(count > 0, numbers, 0))  # largest unpacked length up to each number
    bins: list[list[int]] = [[size]] * int(count[size])
    count[size] = 0
    left = len(lengths) - len(bins)
    stale = True
    while left:
        if stale:
            at_most = np.maximum.accumulate(np.where(count > 0, numbers, 0))
            stale = False
        own: list[int] = []
        gap = size
        while gap and (x := int(at_most[gap])):
            own.append(x)
            gap -= x
            count[x] -= 1
            left -= 1
            if not count[x]:
                at_most = np.maximum.accumulate(np.where(count > 0, numbers, 0))
        if gap and left > 1 and len(own) > 1:
            smallest = own[-1]
            room = gap + smallest
            first = np.flatnonzero(count[:room])  # lengths under room
            if len(first):
                second = at_most[room - first]
                same = (second == first) & (count[first] < 2)
                second = np.where(same, at_most[np.minimum(room - first, first - 1)], second)
                total = np.where(second > 0, first + second, 0)
                k = int(total.argmax())
                if total[k] > smallest:
                    own.pop()
                    count[smallest] += 1
                    for x in (int(first[k]), int(second[k])):
                        own.append(x)
                        count[x] -= 1
                    left -= 1
                    stale = True
        bins.append(own)
    order = np.argsort(lengths, kind="stable")
    held = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    flat = np.fromiter((x for b in bins for x in b), np.int64, len(lengths))
    ends = np.cumsum(flat)
    starts = ends - flat
    firsts = np.cumsum([0, *map(len, bins)])[:-1].astype(np.int64)
    within = starts - starts[firsts][held] if len(flat) else starts
    by_length = np.argsort(flat, kind="stable")  # the k-th shortest place takes the k-th shortest piece
    bin_of, offset_of = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bin_of[order], offset_of[order] = held[by_length], within[by_length]
    return bin_of, offset_of, len(bins)


def token_pieces(docs: DataFrame, tokenizer_path: str, white_space_counts: bool, size: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of each tokenised document: doc_id, piece, start, length, ids_crc32, turn (a number of its own).

    Null and empty texts are the end id alone. Other columns are ignored.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, white_space_counts)
        end = np.array([end_id], "<u4").tobytes()
        turn = TaskContext.get().partitionId() << 33
        for batch in batches:
            for some in slices(batch, 1):
                out: list[tuple] = []
                for doc, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1)), strict=True):
                    ids += end
                    for k, b in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[b : b + 4 * size]
                        out.append((doc, k, b // 4, len(own) // 4, zlib.crc32(own)))
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:]), pa.array(np.arange(turn, turn + len(out)))], names=["doc_id", "piece", "start", "length", "ids_crc32", "turn"])
                turn += len(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(pieces, _PIECES + ", turn long")


def pack(docs: DataFrame, tokenizer_path: str, white_space_counts: bool = False, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and then end_id; null and empty texts are the end id alone. Longer ones are cut into pieces
    of `size`, the last may be shorter. Rows that repeat an id are packed like any others. Other columns are ignored. An
    empty table gives no rows.
    """
    on_workers(docs.sparkSession)
    pieces = stored(token_pieces(docs, tokenizer_path, white_space_counts, size, end_id, id_col, text_col), "pieces")
    shards = max(1, -(-pieces.count() // SHARD_PIECES))

    def packed(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, _ = best_two_fit(own["length"].to_numpy(), size)
        return own.drop(columns=["shard", "turn"]).assign(sequence_id=key[0] * (1 << 32) + bins, offset=offsets)

    shard = F.pmod(F.xxhash64("turn"), F.lit(shards))
    return pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(packed, _PACKED)
