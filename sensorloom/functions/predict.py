"""The surface for model inference: batches of rows to a user's predictor, loaded once per Python worker.

A predictor is made by a function without arguments and called with a pandas frame; models, decoders and devices are its own
business.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Predictor = Callable[[pd.DataFrame], pd.DataFrame]


def predict_rows(rows: DataFrame, make: Callable[[], Predictor], schema: str) -> DataFrame:
    """Per image or prompt: each Arrow batch goes to the predictor once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make()
        for frame in frames:
            if len(frame):
                yield predictor(frame)

    return rows.mapInPandas(run, schema)


def predict_windows(rows: DataFrame, keys: list[str], make: Callable[[], Predictor], schema: str) -> DataFrame:
    """Per window of frames: a group is one window, bounded by its size. The predictor is made once per task."""
    made: list[Predictor] = []

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(make())
        return made[0](frame)

    return rows.groupBy(*keys).applyInPandas(run, schema)
