"""Exact deduplication by sorting the content.

Rows are range-partitioned by sampled splitters and sorted externally (Spark's spilling sorter), so equal texts stand next
to each other; neighbours are compared in full and each run of equal texts keeps one row. The splitter key is the text's
leading bytes, then a 64-bit digest, then the row's id and its number: it is small however long the texts are, equal texts
stay contiguous, and a run of any size is spread over several partitions because id and number take part in the split, also
where ids are null or repeat. Runs cut by a partition's edge are joined again by comparing the edge texts in full, at most two per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, on_workers, partitions, stored

SPLIT_BYTES = 32

_RUNS = "doc_id long, sha string, part int, run int, n long, low long, high long, edge string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in (text, id) order -> one row per input row with its run's size and id range; edge runs carry their text once.

    Only the ids and digests of the current run are held, never its texts.
    """
    part = TaskContext.get().partitionId()
    schema = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("part", pa.int32()), ("run", pa.int32()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("edge", pa.string())])
    ids: list[pa.Array] = []
    current: str | None = None
    sha = ""
    run = 0

    def closed(first: bool, last: bool) -> pa.RecordBatch:
        own = pa.concat_arrays(ids)
        n = len(own)
        present = own.drop_null()
        low, high = (pc.min(present).as_py(), pc.max(present).as_py()) if len(present) else (None, None)
        edge = [current] + [None] * (n - 1) if first or last else [None] * n
        const = lambda v, t: pa.array([v] * n, t)
        return pa.record_batch([own, const(sha, pa.string()), const(part, pa.int32()), const(run, pa.int32()), const(n, pa.int64()), const(low, pa.int64()), const(high, pa.int64()), pa.array(edge, pa.string())], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        text, doc, digest = batch.column("text"), batch.column("doc_id"), batch.column("sha")
        changes = np.flatnonzero(pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)) + 1
        starts = np.concatenate([[0], changes, [len(text)]])
        # Runs that begin and end inside this batch go out together; the last one stays open.
        first_text = text[0].as_py()
        begin = 0
        if current is not None and first_text == current:
            ids.append(doc.slice(0, starts[1]))
            begin = 1
        if begin < len(starts) - 1:
            if current is not None:
                yield closed(run == 0, False)
                run += 1
            whole = starts[begin:-1]
            if len(whole) > 1:  # all but the last, which may go on in the next batch
                sizes = np.diff(whole)
                lo, hi = whole[0], whole[-1]
                part_doc = doc.slice(lo, hi - lo)
                values = part_doc.to_numpy(zero_copy_only=False)
                if part_doc.null_count:  # ids sort nulls first: the last of a run is its largest, the first that isn't null its smallest
                    per = [part_doc.slice(s - lo, k).drop_null() for s, k in zip(whole[:-1], sizes, strict=True)]
                    low = [x[0].as_py() if len(x) else None for x in per]
                    high = [x[-1].as_py() if len(x) else None for x in per]
                else:
                    low, high = values[whole[:-1] - lo].tolist(), values[whole[1:] - 1 - lo].tolist()
                numbers = np.arange(run, run + len(sizes), dtype=np.int32)
                edge: list[str | None] = [None] * int(hi - lo)
                if run == 0:
                    edge[0] = text[int(lo)].as_py()
                yield pa.record_batch([part_doc, digest.slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(np.repeat(numbers, sizes)), pa.array(np.repeat(sizes, sizes).astype(np.int64)), pa.array(low, pa.int64()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(high, pa.int64()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(edge, pa.string())], schema=schema)
                run += len(sizes)
            last = int(whole[-1])
            current, sha, ids = text[last].as_py(), digest[last].as_py(), [doc.slice(last)]
    if current is not None:
        yield closed(run == 0, True)


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: which id of a group of equal texts stays, "smallest" or "largest". Texts are equal when identical; null counts as
    the empty text. Repeated (id, text) rows count in group_size and all carry the same keep_id; a null id never wins over
    another id (a group of null ids only has keep_id null, kept true). Other columns are ignored whatever their names. An
    empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = docs.sparkSession
    on_workers(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumns({"lead": F.substring(F.encode("text", "UTF-8"), 1, SPLIT_BYTES), "mix": F.xxhash64("text"), "sha": F.sha2("text", 256), "turn": F.monotonically_increasing_id()})
    order = ["lead", "mix", "text", "doc_id"]
    split = rows.repartitionByRange(partitions(spark), "lead", "mix", "doc_id", "turn").sortWithinPartitions(*order)
    runs = stored(split.select("doc_id", "text", "sha").mapInArrow(_runs, _RUNS), "exact-runs")

    # Runs at a partition's edges, equal in full text, are one group: two rows per partition at most.
    edges = runs.where("edge is not null").select("part", "run", "n", "low", "high", F.col("edge").alias("text"))
    groups = edges.groupBy("text").agg(F.sum("n").alias("all_n"), F.min("low").alias("all_low"), F.max("high").alias("all_high"), F.collect_list(F.struct("part", "run")).alias("runs"))
    whole = groups.select(F.explode("runs").alias("r"), "all_n", "all_low", "all_high").select("r.part", "r.run", "all_n", "all_low", "all_high")
    # Broadcast is safe: `whole` has no more than two narrow rows for each partition of the sort.
    best = F.col("low" if keep == "smallest" else "high")
    out = runs.drop("edge").join(F.broadcast(whole), ["part", "run"], "left")
    best = F.coalesce(F.col("all_low" if keep == "smallest" else "all_high"), best)
    return out.select("doc_id", best.alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"), F.col("doc_id").eqNullSafe(best).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows that repeat both id and text, one stays.

    Null texts are equal to empty ones (and come back as they are); a null id stays only where a text has no other. Columns
    may have any names. An empty table stays empty.
    """
    name = fresh_name(docs, "content_key")
    key = lambda doc, sha: F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("null")), sha)
    stays = exact_dedup(docs, keep, id_col, text_col).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias(name)).distinct()
    keyed = docs.withColumn(name, key(F.col(id_col).cast("long"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)))
    # Repeated rows are thinned out in each task before any shuffle, so however many there are, few meet.
    return keyed.dropDuplicates([name]).join(stays.hint("merge"), name, "left_semi").select(*[docs[c] for c in docs.columns])
