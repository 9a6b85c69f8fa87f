"""Mixing sources to target weights by temperature.

Each source's share of all tokens is raised to an exponent and normalised. The exponent (0: all sources alike, 1: as they
are) is bisected until the weights meet a target entropy or no source repeats more often than allowed. A source's weight
times the token budget is then realised as a permutation of its blocks: whole passes over all blocks, and of one more pass
as many blocks as the budget holds, the last block in part.

Blocks are dealt by a hash of the stored row's number within a source, so equal rows spread too; they hold about BLOCK_DOCS
documents however large the source, and a source's blocks stand in chunks of about CHUNK_BLOCKS, so no step gathers a source.
Passes are made by ranges of RANGE. Sources are a table too: the driver sees sums over it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, stored

BLOCK_DOCS, CHUNK_BLOCKS = 1_000, 1_000
#: Passes over a block that are made in one row.
RANGE = 4_096
#: Up to so many sources (some 100 bytes each) are broadcast to the documents; more are joined by SALTS parts of each.
BROADCAST_SOURCES, SALTS = 200_000, 64
#: Exponents tried in one pass over the sources, and passes: the interval shrinks by STEPS + 1 in each.
STEPS, PASSES = 32, 8


@dataclass
class Temperature:
    """What weights proportional to share ** exponent come to, over all sources that have tokens."""

    exponent: float
    norm: float  # sum of share ** exponent
    entropy: float  # 1 for equal weights, 0 for one source
    cover: float  # the least budget that takes each source whole at least once
    most: float  # the largest number of passes over one source, for a budget of one token

    def repeats(self, budget: int | None) -> float:
        return self.most * (self.cover if budget is None else budget)


def temperatures(sources: DataFrame, exponents: list[float]) -> list[Temperature]:
    """One pass over sources (src, tokens) for some exponents. Sums are decimal, so they don't depend on their order."""
    some = sources.where("tokens > 0")
    total, low, high, n = some.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.min("tokens"), F.max("tokens"), F.count("*")).first()
    if not n:
        return [Temperature(e, 1.0, 1.0, 0.0, 0.0) for e in exponents]
    exact = lambda c: F.sum(c.cast("decimal(38,18)")).cast("double")
    share = F.col("tokens") / F.lit(float(total))
    rows = some.select(share.alias("share"), F.explode(F.array(*(F.lit(e) for e in exponents))).alias("e")).withColumn("raised", F.pow("share", "e"))
    sums = {r.e: (r.norm, r.logs) for r in rows.groupBy("e").agg(exact(F.col("raised")).alias("norm"), exact(F.col("raised") * F.log("share")).alias("logs")).collect()}
    out = []
    for e in exponents:
        norm, logs = sums[e]
        spread = (math.log(norm) - e * logs / norm) / math.log(n) if n > 1 else 1.0
        # Budget / passes of a source is tokens * norm / share ** e, largest and smallest at the ends for exponents up to 1.
        out.append(Temperature(e, norm, spread, total * norm * (high / total) ** (1 - e), (low / total) ** (e - 1) / (total * norm)))
    return out


def solve(sources: DataFrame, budget: int | None, target_entropy: float | None, max_repeats: float | None) -> Temperature:
    """The least exponent in [0, 1] whose weights have an entropy of at most target_entropy and repeat no source more than max_repeats times.

    Without a budget, the one that covers all sources goes with each exponent. Entropy and repetition fall as the exponent
    grows to 1, so the interval is cut down to where they come to hold. Where even exponent 1 repeats too often (a budget
    above max_repeats times the corpus), or the sources' own entropy is above the target, the exponent is 1.
    """

    def good(t: Temperature) -> bool:
        return (target_entropy is None or t.entropy <= target_entropy) and (max_repeats is None or t.repeats(budget) <= max_repeats)

    low, best = 0.0, None
    high = 1.0
    for k in range(PASSES):
        tried = temperatures(sources, [low + (high - low) * i / (STEPS + 1) for i in range(0 if k == 0 else 1, STEPS + 2)])
        at = next((i for i, t in enumerate(tried) if good(t)), len(tried) - 1)
        best = tried[at]
        if best.exponent == 0.0:
            break
        low, high = tried[at - 1].exponent if at else low, best.exponent
    return best


def token_count(text: Column) -> Column:
    """White-space-separated words; null and empty texts have none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")).cast("long")


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float | None = 0.97, max_repeats: float | None = 4.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per taken copy of a document: doc_id, source, n_tokens, copy (0 for the first pass), block, place, text_hash.

    Blocks depend on where rows are stored, so two runs may mix in another order; what each source gets is the same.

    budget: tokens of the mixture, by default the least that takes every source whole at least once. place, in (0, 1], is
    where a copy stands in the mixture: sorted by it, any stretch holds the sources in their weights. A source's budget is
    met to within the document that reaches it. A first pass that the budget covers takes all documents, also those without
    tokens. Null sources are one source of their own; rows that repeat an id are documents like any others. Other columns
    are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _source(source_col).alias("src"), token_count(F.col(text_col).cast("string")).alias("n_tokens"), _text_hash(text_col).alias("text_hash"), F.monotonically_increasing_id().alias("turn"))
    rows = stored(rows, "mix-rows")
    sources = stored(rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "mix-sources")
    at = solve(sources, budget, target_entropy, max_repeats)
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    share = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(at.exponent)) / F.lit(at.norm)).otherwise(0.0)
    whole = F.lit(float(at.cover if budget is None else budget))
    plan = stored(sources.select("src", F.ceil(F.col("docs") / BLOCK_DOCS).alias("n_blocks"), F.round(share * whole).cast("long").alias("want"), F.col("tokens").alias("have")), "mix-plan")

    # A document's block and its order there come from hashes of its stored row; blocks are permuted anew in each pass.
    mixed_rows = rows.withColumn("mix", F.xxhash64("doc_id", "src", "text_hash", "turn", F.lit(seed))).drop("turn")
    if plan.count() <= BROADCAST_SOURCES:
        keyed = mixed_rows.join(F.broadcast(plan), "src")
    else:  # a source that many documents have is spread over SALTS tasks
        parts = plan.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        keyed = mixed_rows.withColumn("salt", F.pmod("mix", F.lit(SALTS))).join(parts.hint("merge"), ["src", "salt"]).drop("salt")
    keyed = keyed.withColumn("block", F.pmod("mix", "n_blocks")).withColumn("shuffled", F.xxhash64("mix", F.lit(seed + 1)))
    blocks = keyed.groupBy("src", "block").agg(F.sum("n_tokens").alias("size"), *(F.first(c).alias(c) for c in ("want", "have", "n_blocks")))
    # A small source may take very many passes: first a row for each range of them, spread over tasks, then a row for each.
    passes = F.greatest(F.when(F.col("have") > 0, F.ceil(F.col("want") / F.greatest("have", F.lit(1)))).otherwise(1), F.lit(1)).cast("long")
    ranges = blocks.withColumn("passes", passes).withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("passes") - 1) / RANGE))))
    ranges = ranges.repartition("src", "block", "range")
    passed = ranges.withColumn("copy", F.explode(F.sequence(F.col("range") * RANGE, F.least((F.col("range") + 1) * RANGE, F.col("passes")) - 1))).drop("passes", "range")
    # Narrow rows, one per BLOCK_DOCS documents and pass, in the order of a hash. Leading bits of it make chunks.
    chunks = F.ceil(F.col("n_blocks") / CHUNK_BLOCKS)
    turn = F.xxhash64("block", "copy", F.lit(seed + 2))
    chunk = F.least(F.floor((turn / F.lit(2.0**64) + 0.5) * chunks), chunks - 1)
    passed = stored(passed.withColumn("turn", turn).withColumn("chunk", chunk), "mix-passes")
    per_pass = Window.partitionBy("src", "copy").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = passed.groupBy("src", "copy", "chunk").agg(F.sum("size").alias("chunk_size")).withColumn("ahead", F.coalesce(F.sum("chunk_size").over(per_pass), F.lit(0)))
    order = Window.partitionBy("src", "copy", "chunk").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = passed.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).join(ahead.drop("chunk_size").hint("merge"), ["src", "copy", "chunk"])
    placed = placed.withColumn("begin", F.col("copy") * F.col("have") + F.col("ahead") + F.col("before"))
    first_whole = "(copy = 0 AND want >= have)"
    taken = stored(placed.where(f"begin < want OR {first_whole}").select("src", "block", "copy", "begin", "want", "have"), "mix-taken")

    before = Window.partitionBy("src", "block").orderBy("shuffled", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    inside = keyed.select("doc_id", "src", "n_tokens", "text_hash", "block", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("ahead"))
    both = inside.join(taken.hint("merge"), ["src", "block"]).withColumn("at", F.col("begin") + F.col("ahead"))
    return both.where(f"at < want OR {first_whole}").select(
        "doc_id",
        F.when(F.col("src") != "none", F.substring("src", 3, 1 << 30)).alias("source"),
        "n_tokens",
        "copy",
        "block",
        F.least((F.col("at") + 1) / F.greatest("want", F.lit(1)), F.lit(1.0)).alias("place"),
        "text_hash",
    )


def _source(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("none"))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, as often as mix() takes them, with all their columns.

    Rows equal in id, source and text are taken together, as often as any of them is. Null ids, sources and texts, empty texts and empty tables are as in
    mix(); columns may have any names.
    """
    takes = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    row_key, times, nth = (fresh_name(docs, n) for n in ("take_key", "times", "take"))
    key = lambda doc, src, text: F.concat_ws("/", F.coalesce(doc.cast("string"), F.lit("null")), text.cast("string"), src)
    taken = takes.select(key(F.col("doc_id"), _source("source"), F.col("text_hash")).alias(row_key), "copy").distinct().groupBy(row_key).agg(F.count("*").cast("int").alias(times))
    keyed = docs.withColumn(row_key, key(F.col(id_col).cast("long"), _source(source_col), _text_hash(text_col)))
    both = keyed.join(taken.hint("merge"), row_key)
    return both.withColumn(nth, F.explode(F.sequence(F.lit(1), times))).select(*[docs[c] for c in docs.columns])
