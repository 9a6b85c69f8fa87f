"""Merkle manifest of a dataset: every row a leaf, every source a subtree, one root, and a proof for each row.

Leaves are ranked in their source, and the rank's base-ARITY digits are columns. Rows meet once in bounded blocks of
ARITY ** LEVELS consecutive leaves; there the lowest digit is grouped away, then the next, each time nesting the children's
structs in their parent's, so a block ends as one row. Block roots are the leaves of the next layer, and so on up to the
sources' subroots, whose tree is made alike. On the way down a layer's proofs meet the blocks below by grouping, and one
transform and explode emits each leaf with its path; nothing is joined on rows or blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import on_workers, partitions, stored

#: Children of a node, and levels in a block: blocks hold 3 ** 6 = 729 leaves.
ARITY, LEVELS = 3, 6
WIDTH = ARITY**LEVELS
#: One step of a path: what stands before and after the node in its run; `alone` where the node is the root of its tree already.
STEP = "struct<before:string,after:string,alone:boolean>"
#: Nodes to a task, and so to a file, of what is stored. On a local disk each file costs processes (chmod), and as one starts
#: it counts with all of its executor's memory.
ROWS = 8192


def digest(parts: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value's part of a leaf: its UTF-8 byte count, a colon and the value as text; - for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path (array of STEP, lowest first) come to."""
    return F.aggregate(path, leaf, lambda node, step: F.when(step["alone"], node).otherwise(F.sha2(F.concat(step["before"], node, step["after"]), 256)))


def siblings(path: Column) -> Column:
    """All sibling digests of a path as one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def _few(df: DataFrame, n: int) -> DataFrame:
    """df, made of n nodes, in tasks of about ROWS of them: each takes whole partitions of df in turn, and nothing moves."""
    return df.coalesce(max(1, -(-n // ROWS)))


def _ranked(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Adds rank to n rows: a row's position from 0 in its tree by `order` (nulls first); the last name tells equal rows apart.

    Rows are range-partitioned on (tree, *order) and counted where they lie; a tree of any size spreads. Only a partition's
    first tree can have begun before it, so what is added to ranks is one number for each partition.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, n, run = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0)
            change = np.flatnonzero(pc.not_equal(own.slice(1), own.slice(0, len(own) - 1)).to_numpy(zero_copy_only=False)) + 1
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.append(starts, len(own)))
            same = own[0].as_py() == tree
            carried = np.zeros(len(starts), np.int64)
            carried[0] = n if same else 0
            runs = run + np.arange(len(starts)) + (0 if same or tree is None else 1)
            position = np.arange(len(own)) - np.repeat(starts - carried, sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.repeat(runs == 0, sizes)), pa.array(position)], names=[*batch.schema.names, "first", "position"])
            tree, run, n = own[-1].as_py(), int(runs[-1]), int(position[-1]) + 1

    split = rows.select("tree", *(c for c in rows.columns if c != "tree")).repartitionByRange(partitions(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    split = split.withColumn("part", F.spark_partition_id())  # of the ranges, also where a task takes some of them in turn
    schema = T.StructType([*split.schema.fields, *T._parse_datatype_string("first boolean, position long").fields])
    counted = stored(_few(split.mapInArrow(count, schema), n), "merkle-ranks")
    # Only trees that open a partition can go on from one before: fewer than partitions, and so are their rows here, but twice.
    opening = counted.where("first AND position = 0").select("tree").distinct()
    sizes = counted.join(F.broadcast(opening), "tree").groupBy("tree", "part").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("part", ahead.alias("before")).where("before is not null")
    moved = counted.join(F.broadcast(before), "part", "left")
    return moved.withColumn("rank", F.col("position") + F.when(F.col("first"), F.coalesce("before", F.lit(0))).otherwise(0)).drop("part", "first", "position", "before")


def _rolled(nodes: DataFrame) -> DataFrame:
    """(tree, rank, node, item) -> (tree, block, node, nest): one row a block, its nodes nested by digit."""
    digits = [F.pmod(F.floor(F.col("rank") / ARITY**k), F.lit(ARITY)).cast("tinyint").alias(f"d{k}") for k in range(LEVELS)]
    rows = nodes.select("tree", F.floor(F.col("rank") / WIDTH).alias("block"), *digits, "node", F.col("item").alias("nest"))
    rows = rows.repartition(partitions(nodes.sparkSession), "tree", "block")
    for k in range(LEVELS):
        above = [f"d{j}" for j in range(k + 1, LEVELS)]
        grouped = rows.groupBy("tree", "block", *above).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "node", "nest"))).alias("nest"))
        leading = reduce(lambda a, b: a & b, (F.col(d) == 0 for d in above), F.col("block") == 0)
        whole = F.sha2(F.array_join(F.transform("nest", lambda x: x["node"]), ""), 256)
        # A run of one that opens its level is all there is: the tree's root already.
        rows = grouped.withColumn("node", F.when(leading & (F.size("nest") == 1), F.col("nest")[0]["node"]).otherwise(whole))
    return rows.select("tree", "block", "node", "nest")


def _spread(nest: Column, level: int, leading: Column, path: Column) -> Column:
    """The leaves of nested nodes: array of (d, node, item, path), where `path` holds the steps above, lowest first."""

    def step(x: Column, i: Column) -> Column:
        text = lambda some: F.array_join(F.transform(some, lambda y: y["node"]), "")
        rest = F.slice(nest, i + 2, F.lit(ARITY))
        return F.struct(text(F.slice(nest, F.lit(1), i)).alias("before"), text(rest).alias("after"), (leading & (F.size(nest) == 1)).alias("alone"))

    def below(x: Column, i: Column) -> Column:
        steps = F.concat(F.array(step(x, i)), path)
        if level == 0:
            return F.array(F.struct(x["d"].alias("d"), x["node"].alias("node"), x["nest"].alias("item"), steps.alias("path")))
        return _spread(x["nest"], level - 1, leading & (x["d"] == 0), steps)

    return F.flatten(F.transform(nest, below))


def _emitted(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks and what stands above each (tree, block, over: struct with path) -> (tree, item, node, over, path), a row a leaf."""
    both = blocks.select("tree", "block", "nest", F.lit(None).cast(above.schema["over"].dataType).alias("over")).unionByName(above, allowMissingColumns=True)
    met = both.groupBy("tree", "block").agg(F.first("nest", True).alias("nest"), F.first("over", True).alias("over"))
    leaves = F.explode(_spread(F.col("nest"), LEVELS - 1, F.col("block") == 0, F.col("over")["path"]))
    return met.select("tree", "over", leaves.alias("leaf")).select("tree", F.col("leaf.item").alias("item"), F.col("leaf.node").alias("node"), "over", F.col("leaf.path").alias("path"))


def _layers(ranked: DataFrame, what: str, n: int) -> tuple[list[DataFrame], int]:
    """Layers of blocks over n rows (tree, rank, node, item), up to one block a tree; and the number of trees."""
    layers, nodes = [], ranked
    while True:
        layers.append(stored(_few(_rolled(nodes), n), f"merkle-{what}"))
        last, n = layers[-1].agg(F.coalesce(F.max("block"), F.lit(0)), F.count("*")).first()
        if last == 0:
            return layers, n
        nodes = layers[-1].select("tree", F.col("block").alias("rank"), "node", F.col("block").alias("item"))


def manifest(docs: DataFrame, fields: Sequence[str], id_col: str = "doc_id", source_col: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, leaf, subroot, root, path (array of STEP, lowest first) and the columns of `carry`.

    A leaf is the digest of its fields, each as its UTF-8 byte count, a colon and its text, or - for null. Leaves of a source
    (null is one, and comes first) ascend by id, null ids first, equal ids by leaf; rows equal in both have one leaf, so their
    order changes nothing. Every ARITY consecutive nodes become the digest of their texts, also a last run of fewer, until one
    is left: the source's subroot. Subroots, in their sources' UTF-8 order, come to the root alike. `carry` holds small values
    computed from docs that come back with each row. Columns may have any names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    on_workers(spark)
    extra = carry or {}
    item = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), *(c.alias(n) for n, c in extra.items()))
    tree = F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("none"))  # null first
    leaves = docs.select(tree.alias("tree"), digest([field(F.col(c)) for c in fields]).alias("node"), item.alias("item"))
    # Texts are read once; equal rows get numbers of their own, so that they spread over partitions.
    leaves = stored(leaves.withColumn("nth", F.monotonically_increasing_id()), "merkle-leaves").withColumn("id", F.col("item.doc_id"))
    n = leaves.count()
    layers, trees = _layers(_ranked(leaves, ["id", "node", "nth"], n).drop("id", "nth"), "blocks", n)
    tops = layers[-1].select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "node", F.struct(F.col("tree").alias("tree"), F.col("node").alias("subroot")).alias("item"))
    forest, _ = _layers(_ranked(tops, ["name"], trees).drop("name"), "sources", trees)

    # Down again: each layer's paths are what stands above the blocks of the layer below.
    over = forest[-1].select("tree", "block", F.struct(F.col("node").alias("root"), F.array().cast(f"array<{STEP}>").alias("path")).alias("over"))
    for layer in reversed(forest):
        out = _emitted(layer, over)
        if layer is not forest[0]:
            over = out.select("tree", F.col("item").alias("block"), F.struct(F.col("over.root"), "path").alias("over"))
    over = out.select("item.tree", F.lit(0).cast("long").alias("block"), F.struct(F.col("over.root"), F.col("item.subroot"), "path").alias("over"))
    for layer in reversed(layers):
        out = _emitted(layer, over)
        if layer is not layers[0]:
            over = out.select("tree", F.col("item").alias("block"), F.struct("over.root", "over.subroot", "path").alias("over"))
    return _few(out, n).select("item.doc_id", "item.source", F.col("node").alias("leaf"), "over.subroot", "over.root", "path", *(F.col("item")[n].alias(n) for n in extra))
