"""Sorted groups inside Arrow batches: what a task does with all rows of a key, without a Python call for each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where the runs of equal keys begin; nulls are equal."""
    n = batch.num_rows
    change = np.zeros(max(n - 1, 0), bool)
    for key in keys:
        a, b = batch.column(key).slice(1), batch.column(key).slice(0, max(n - 1, 0))
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        change |= differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return np.concatenate([[0], np.flatnonzero(change) + 1]) if n else np.array([], np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by keys, cut so that no key is in two of them. Only a batch's last group waits for the next."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        first = starts(batch, keys)
        if held and len(starts(joined([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), keys)) == 2:
            yield joined(held)
            held = []
        if len(first) > 1:
            cut = int(first[-1])
            yield joined([*held, batch.slice(0, first[1]), batch.slice(first[1], cut - first[1])] if held else [batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield joined(held)
