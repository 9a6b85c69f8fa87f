"""Bounded labelled samples and logistic calibration, shared by the two text classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, learn_from, max_rows: int) -> DataFrame:
    """text, label (0/1) of at most max_rows labelled documents that learn_from (a condition on the id) allows.

    The sample is the labels with the smallest hashes of their id. Null labels and ids are left out; an id labelled more than
    once takes its larger label. The labels are broadcast: max_rows of them at most, so no text moves.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    mix = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    some = known.where(learn_from(F.col("doc_id"))).orderBy(mix, "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(some), "doc_id").withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(4)))


class Logistic:
    """Logistic regression on a few standardised features, fitted by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 60) -> None:
        self.mean, self.spread = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        a = self._design(x)
        w = np.zeros(a.shape[1])
        if len(y) and 0 < y.sum() < len(y):
            penalty = l2 * len(y) * np.r_[1e-3, np.ones(a.shape[1] - 1)]
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
                step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
                w -= step * min(1.0, 5 / (1e-9 + np.abs(step).max()))
        else:  # one class only, or none: its share, kept from 0 and 1
            share = (y.sum() + 0.5) / (len(y) + 1)
            w[0] = np.log(share / (1 - share))
        self.weights = w

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.spread, -12, 12)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30)))
