"""Quality by compression: a text is good if a dictionary of good texts compresses it better than one of bad texts.

Whole texts are compressed window by window, so the dictionary counts as much at a long text's end as at its start. The
difference of the two sizes over the raw size, with the compressed share itself (repetition) and the length, becomes a
probability by a logistic fit on labelled texts that the dictionaries were not built from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import on_workers
from .labelled import Logistic, training_rows

#: At most so many labelled documents, and windows of them for each dictionary: the bound on what fitting gathers.
MAX_ROWS, MAX_WINDOWS = 12_000, 4_000
DICT_BYTES, LEVEL, WINDOW_CHARS, SAMPLE_CHARS = 112_640, 3, 4_000, 2_000


def dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary of the samples; their plain concatenation where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:] or b"\x00" * 8


class Compressors:
    """Compressed and raw sizes of texts under both dictionaries."""

    def __init__(self, bad: bytes, good: bytes) -> None:
        self.own = []
        for raw in (bad, good):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.own.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> tuple[int, int, int]:
        """raw, with the bad dictionary, with the good one."""
        raw = bad = good = 0
        for at in range(0, len(text), WINDOW_CHARS):
            data = text[at : at + WINDOW_CHARS].encode("utf-8", "replace")
            raw += len(data)
            bad += len(self.own[0].compress(data))
            good += len(self.own[1].compress(data))
        return raw, bad, good


def features(sizes: np.ndarray) -> np.ndarray:
    """(raw, bad, good) sizes -> the difference, and what its meaning depends on: how much the text shrinks at all, and its length.

    By the difference alone the ranking is as good, but repetitive junk near a difference of zero passes for good.
    """
    raw = np.maximum(sizes[:, 0], 1)
    z, r = (sizes[:, 2] - sizes[:, 1]) / raw, (sizes[:, 1] + sizes[:, 2]) / (2 * raw)
    return np.column_stack([z, r, raw**-0.5, z * z, r * r, z * r, z * raw**-0.25, r * raw**-0.25])


class QualityModel:
    def __init__(self, bad: bytes, good: bytes, calibration: Logistic | None = None) -> None:
        self.bad, self.good, self.calibration = bad, good, calibration


def fit(docs: DataFrame, labels: DataFrame, learn_from, max_rows: int = MAX_ROWS, max_windows: int = MAX_WINDOWS) -> QualityModel:
    """Learn from at most max_rows labelled documents: dictionaries from three folds of four, calibration from the other.

    Of the labelled texts' windows, max_windows of each label (those with the least hashes) make its dictionary. Null labels
    and ids are left out, null texts count as empty, rows that repeat a labelled id all count. Without labelled documents, or
    with one class only, each text's score is that class's share. Other columns are ignored.
    """
    on_workers(docs.sparkSession)
    rows = training_rows(docs, labels, "quality", learn_from, max_rows)
    span = F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / SAMPLE_CHARS).cast("int"))
    windows = rows.where("fold > 0").select("label", F.explode(F.transform(span, lambda k: F.substr(F.col("text"), k * SAMPLE_CHARS + 1, F.lit(SAMPLE_CHARS)))).alias("w")).where(F.length("w") >= 8)
    mix = F.xxhash64("w", F.lit("window"))
    samples = {k: [r.w.encode() for r in windows.where(f"label = {k}").orderBy(mix, "w").limit(max_windows).select("w").collect()] for k in (0, 1)}
    model = QualityModel(dictionary(samples[0]), dictionary(samples[1]))
    known = _sizes(rows.where("fold = 0").select("label", "text"), model, "label").collect()  # numbers of max_rows rows at most
    sizes = np.array([(r.raw, r.bad, r.good) for r in known], float).reshape(-1, 3)
    model.calibration = Logistic(features(sizes), np.array([r.key for r in known], float))
    return model


def _sizes(rows: DataFrame, model: QualityModel, key: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((model.bad, model.good))  # two dictionaries of DICT_BYTES

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Compressors(*shared.value)
        for batch in batches:
            out = np.array([own.sizes(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, 3)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array(out[:, k]) for k in range(3))], names=["key", "raw", "bad", "good"])

    return rows.select(F.col(key).alias("key"), "text").mapInArrow(sizes, "key long, raw long, bad long, good long")


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, raw_bytes, bad_bytes, good_bytes, score: the probability that each whole text is good.

    Null texts count as empty; all empty texts share one score. Repeated rows are scored alike. Other columns are ignored.
    """
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        compressors = Compressors(own.bad, own.good)
        for batch in batches:
            sizes = np.array([compressors.sizes(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, 3)
            p = own.calibration(features(sizes.astype(float)))
            yield pa.record_batch([batch.column(0), *(pa.array(sizes[:, k]) for k in range(3)), pa.array(p)], names=["doc_id", "raw_bytes", "bad_bytes", "good_bytes", "score"])

    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(scores, "doc_id long, raw_bytes long, bad_bytes long, good_bytes long, score double")
