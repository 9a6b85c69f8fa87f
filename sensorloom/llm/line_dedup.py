"""Line deduplication across documents, with DataFrame functions only.

Hashes of the lines' keys are range-partitioned and sorted by document and position inside each hash, and the first
document of each key streams past its later ones. What comes back per document is a compressed keep bitmap (alternating run
lengths: kept, dropped, kept, ...), never text.

A key that holds a large share of all lines would fill one range, so such keys are counted first (pre-aggregated per
task); their first documents, at most a few per partition, are broadcast and decide their lines without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id while sorting: smaller than all others.
NO_ID = -(1 << 63)
#: A key is hot if it has more than 1 / (HOT_SHARE * partitions) of all lines: so there are under HOT_SHARE * partitions.
HOT_SHARE = 8


def line_key(line: Column) -> Column:
    """Line -> key: ASCII white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row that loses lines: doc_id, text_hash, runs array<int> (kept, dropped, kept, ... from the first line), n_dropped.

    A line goes if its key has at least min_chars code points and a document with a smaller id holds the key. Rows that lose
    none have no bitmap. Null ids: such rows count as one document, smaller than all others. Rows that repeat an id count as
    one document too, but each has its own bitmap, by its text; rows that repeat both share one. Null and empty texts are
    one empty line. An empty table gives no rows.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash.alias("text_hash"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    none = F.lit(NO_ID)
    # Two hashes of different seeds: together 128 bits.
    hashed = keyed.select(F.coalesce("doc_id", none).alias("doc"), "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))
    hashed = stored(hashed, "line-hashes")  # texts are split and hashed once; what follows reads narrow rows

    # Counts are partly summed in each task before the shuffle; keys of one line or one document are of no further use.
    counted = hashed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
    shared = stored(counted.where("n > 1 AND first_doc < last_doc").drop("last_doc"), "line-counts")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = shared.where(F.col("n") > total / (HOT_SHARE * partitions(docs.sparkSession)))
    # Broadcast is safe: under HOT_SHARE rows for each shuffle partition pass that filter.
    marked = hashed.join(F.broadcast(hot.drop("n")), ["h1", "h2"], "left")
    by_count = marked.where("first_doc < doc").select("doc", "text_hash", "pos")

    # Lines go by range of hash, then stand by document and position; the running first document streams along.
    cold = marked.where("first_doc IS NULL").repartitionByRange(partitions(docs.sparkSession), "h1")
    stream = Window.partitionBy("h1", "h2").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_order = cold.select("doc", "text_hash", "pos", F.first("doc").over(stream).alias("first_doc")).where("first_doc < doc").select("doc", "text_hash", "pos")

    row = ["doc", "text_hash"]
    gone = by_order.unionByName(by_count).distinct()
    near = Window.partitionBy(*row).orderBy("pos")
    islands = gone.withColumn("island", F.col("pos") - F.row_number().over(near))
    runs = islands.groupBy(*row, "island").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("len"))
    before = F.lag(F.col("start") + F.col("len"), 1, 0).over(Window.partitionBy(*row).orderBy("start"))
    pairs = runs.withColumn("kept", (F.col("start") - before).cast("int"))
    packed = pairs.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("start", "kept", "len"))).alias("r"), F.sum("len").alias("n_dropped"))
    return packed.select(F.when(F.col("doc") != none, F.col("doc")).alias("doc_id"), "text_hash", F.flatten(F.transform("r", lambda x: F.array(x["kept"], x["len"]))).alias("runs"), "n_dropped")


def apply_bitmap(text: Column, runs: Column) -> Column:
    """The lines of text that the runs keep, joined again. Null runs keep all."""
    lines = lines_of(text)
    bits = F.flatten(F.transform(F.coalesce(runs, F.array().cast("array<int>")), lambda n, i: F.array_repeat(i % 2 == 0, n)))
    pairs = F.zip_with(lines, bits, lambda line, bit: F.struct(line.alias("line"), F.coalesce(bit, F.lit(True)).alias("bit")))
    return F.array_join(F.transform(F.filter(pairs, lambda p: p["bit"]), lambda p: p["line"]), "\n")


def line_dedup(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, runs, kept_text. See keep_bitmaps for the rules. Other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    maps = stored(keep_bitmaps(rows, min_chars, "doc_id", "text"), "line-bitmaps")
    same = rows["doc_id"].eqNullSafe(maps["doc_id"]) & (rows["text_hash"] == maps["text_hash"])
    both = rows.join(maps.hint("merge"), same, "left").drop(maps["doc_id"], maps["text_hash"])
    return both.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        "runs",
        F.when(F.col("runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(apply_bitmap(F.col("text"), F.col("runs"))).alias("kept_text"),
    )
