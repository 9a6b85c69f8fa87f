"""Set-similarity self join on word shingles by chosen paths.

After Christiani, Pagh and Sivertsen, "Scalable and robust set similarity join" (2018). Each text is the set of its shingles'
hashes. In a run, a set x picks each shingle with chance PICKED / (threshold * |x|) (deeper down DEEPER in place of PICKED), by a hash that all sets share, so
similar sets meet on a shingle that both picked. Where more than BUCKET sets meet, they split again on the next picks, up to LEVELS
deep; buckets that are small, or whose members are alike, are compared by brute force, exactly. A set picks the same shingles under
every parent of a run's level, so a pair gets through a level if it shares any of them: the chance of meeting in one run is at least
the product of the levels' chances, which gives the number of runs for the target recall.

* Texts with equal sets are one class from the start, so copies cost nothing.
* Buckets with the same members are compared once. A pair that meets in several buckets is counted in the first only.
* Comparing gives each set its number of links and a local group, never the pairs. Large buckets are compared in block pairs.
* Groups are the connected components of all links, found by label propagation over narrow rows.
* Where only groups are asked for, a large bucket of alike sets isn't compared in all block pairs: each set is compared within
  two blocks, dealt by different hashes, which joins near copies to one component in linear work. Then only sets outside their
  bucket's largest component are compared with the rest of it, so no link between components is lost.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, on_workers, partitions, spread_join, stored, stored_alone

BUCKET, LEVELS, BLOCK = 64, 3, 512
#: A bucket of this average similarity isn't split further. The estimate: how often two members share their next least hash.
DENSE = 0.5
#: Shingles that a set picks at the first level and at deeper ones, about, times the threshold. Deeper picks cost only where a
#: bucket splits, and save runs, which cost everywhere.
PICKED, DEEPER = 2.0, 3.1
KEPT_WORDS, TEXT_BYTES = 200_000, 1 << 20
_NO_ID = -(1 << 63)
_SEED = np.random.default_rng(20180607)
#: An odd multiplier for each run and level, from one seed.
PICKS = (_SEED.integers(0, 2**63, 64 * LEVELS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
WORDS = re.compile(r"\w+").findall


def runs_for(target_recall: float) -> int:
    """Runs after which a pair at the threshold or over has met, even in buckets split to the last level, with the target chance.

    Such a pair shares at least threshold * (the larger size) elements, and shares a pick where the larger set picks one of them.
    So it shares at least PICKED (DEEPER) picks on average, whatever its sizes are, and none with a chance of at most exp(-PICKED).
    """
    meets = (1 - math.exp(-PICKED)) * (1 - math.exp(-DEEPER)) ** (LEVELS - 1)
    return max(1, math.ceil(math.log(1 - target_recall) / math.log(1 - meets)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Texts -> each one's sorted distinct 64-bit hashes of its runs of `width` words; a shorter text's words are one shingle; none for no words."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        words, known = [WORDS(t.lower()) for t in texts], self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in set().union(*words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter((known[w] for own in words for w in own), np.uint64, sum(map(len, words)))
        runs = self._runs(ids, self.width)  # those over the end of a text are left out below
        out, begin = [], 0
        for own in words:
            n = len(own)
            some = runs[begin : begin + n - self.width + 1] if n >= self.width else self._runs(ids[begin : begin + n], n)[: min(n, 1)]
            out.append(np.unique(some))
            begin += n
        return out

    @staticmethod
    def _runs(ids: np.ndarray, width: int) -> np.ndarray:
        n = max(0, len(ids) - width + 1)
        out = np.full(n, np.uint64(width))
        for k in range(width):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
        return out


def _fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def _picks(sets: list[np.ndarray], runs: int, threshold: float) -> pa.ListArray:
    """For each set, run and level the shingles picked, least hash first, as signed 64-bit numbers; many sets at a time."""
    n_lists, sizes = runs * LEVELS, np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    limits = [np.array([min(2**64 - 1, int(picked * 2**64 / (threshold * n))) if n else 0 for n in sizes.tolist()], np.uint64)[owner] for picked in (PICKED, DEEPER)]
    places, lists, hashes = [], [], []
    for k, odd in enumerate(PICKS[:n_lists]):
        h = _mixed(tokens * odd)
        own = np.flatnonzero(h <= limits[k % LEVELS > 0])
        places.append(own)
        lists.append(owner[own] * n_lists + k)
        hashes.append(h[own])
    of = np.concatenate(lists) if lists else np.empty(0, np.int64)
    order = np.lexsort((np.concatenate(hashes), of)) if len(of) else np.empty(0, np.int64)
    inner = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sets) * n_lists))]).astype(np.int32)
    values = tokens[np.concatenate(places)[order]].view(np.int64) if len(of) else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n_lists), pa.ListArray.from_arrays(pa.array(inner), pa.array(values)))


def _stretches(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of up to 512 rows and about TEXT_BYTES of a text column."""
    sizes = pc.cumulative_sum(pc.binary_length(batch.column(column)).cast(pa.int64())).to_numpy()
    begin = 0
    while begin < batch.num_rows:
        done = sizes[begin - 1] if begin else 0
        end = min(begin + 512, max(begin + 1, int(np.searchsorted(sizes, done + TEXT_BYTES))))
        yield batch.slice(begin, end - begin)
        begin = end


def _compare(ids: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], buckets: list[np.ndarray], blocks: np.ndarray, bucket: int, i: int, j: int, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids with a partner among these sets, the texts they newly link to, and a local group's least id."""
    sizes = np.array([len(s) for s in sets], np.int64)
    m = len(ids)

    def shared(parts: list[np.ndarray]) -> np.ndarray:
        """Numbers of common elements of each two, from a dense matrix over the elements that two or more hold."""
        owner = np.repeat(np.arange(m), [len(p) for p in parts])
        _, at, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        held = count[at] > 1
        number = np.cumsum(count > 1) - 1
        owner, at = owner[held], number[at[held]]
        common = np.zeros((m, m), np.float32)
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        for a in range(0, int((count > 1).sum()), 4096):
            lo, hi = np.searchsorted(at, [a, a + 4096])
            matrix = np.zeros((m, min(4096, int(at[hi - 1]) - a + 1)), np.float32)
            matrix[owner[lo:hi], at[lo:hi] - a] = 1
            common += matrix @ matrix.T
        return common

    # Sums of products are exact in float32 up to 2^24 common elements, more than a text of 100 MB has.
    common = np.rint(shared(sets)).astype(np.int64)
    num, den = threshold.numerator, threshold.denominator
    similar = common * (num + den) >= num * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(similar, False)
    if i != j:  # two blocks: pairs within one are another task's
        similar &= blocks[:, None] != blocks[None, :]
    if not similar.any():
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    before = [b[b < bucket] for b in buckets]
    first = similar & (shared(before) == 0) if any(len(b) for b in before) else similar
    # A pair's first bucket counts it and links it; all others pass it over.
    similar = first
    if not similar.any():
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    links = similar @ copies
    has = np.flatnonzero(similar.any(axis=1))
    root = np.arange(m)
    while True:  # the least index reachable, by repeated minimum over partners
        least = np.where(similar[has], root[None, :], m).min(axis=1)
        new = root.copy()
        new[has] = np.minimum(root[has], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    low = ids.copy()
    np.minimum.at(low, root, ids)
    return ids[has], links[has], low[root[has]]


def _asked(chosen: DataFrame, classes: DataFrame, runs: int) -> DataFrame:
    """Classes that meet others in some bucket to compare, with those buckets (key, number of members, whether large and alike)."""
    # Level by level: keys that several classes share are buckets; too large ones split on the next picks.
    at_level = lambda r, k: F.element_at("picks", r * LEVELS + k + 1)
    per_run = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.transform(at_level(r, 0), lambda t: F.struct(F.xxhash64(r, t).alias("key"), F.slice("picks", r * LEVELS + 2, LEVELS - 1).alias("rest"))))
    level = stored(chosen.select("cls", F.explode(F.flatten(per_run)).alias("p")).select("cls", "p.key", "p.rest"), "join-level")
    finals, members = [], []
    for k in range(LEVELS):
        sizes = level.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y")).where("m > 1")
        sizes = stored(sizes, "join-sizes")
        members.append(level.select("key", "cls"))
        if k == LEVELS - 1:
            finals.append(sizes.withColumn("dense", F.lit(False)))
            break
        large = level.join(sizes.where(F.col("m") > BUCKET).select("key").hint("merge"), "key", "left_semi")
        large = stored(large, "join-large")
        # Two sets have the same least hash with a chance of their similarity, so a row per member tells near copies from others.
        alike = large.groupBy("key", F.get(F.element_at("rest", 1), F.lit(0)).alias("t")).agg(F.count("*").cast("double").alias("c"))
        alike = alike.groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.when(F.col("t").isNotNull(), F.col("c") * F.col("c"))).alias("c"))
        dense = stored(alike.where(F.col("c") >= DENSE * F.col("m") * F.col("m")).select("key"), "join-dense")
        finals.append(sizes.join(dense.withColumn("dense", F.lit(True)).hint("merge"), "key", "left").withColumn("dense", F.coalesce("dense", F.lit(False))).where((F.col("m") <= BUCKET) | F.col("dense")))
        parted = large.join(dense.hint("merge"), "key", "left_anti")
        parted = parted.select("cls", F.col("key").alias("parent"), F.explode(F.element_at("rest", 1)).alias("t"), F.slice("rest", 2, LEVELS).alias("rest"))
        level = stored(parted.select("cls", F.xxhash64("parent", "t").alias("key"), "rest"), "join-level")
    every = finals[0]
    for more in finals[1:]:
        every = every.unionByName(more)
    kept = stored(every.groupBy("m", "x", "y").agg(F.min("key").alias("key"), F.bool_or("dense").alias("dense")).select("key", "m", "dense"), "join-buckets")
    met = members[0]
    for more in members[1:]:
        met = met.unionByName(more)
    met = met.distinct().join(kept.hint("merge"), "key")
    lists = met.groupBy("cls").agg(F.collect_list(F.struct("key", "m", "dense")).alias("buckets"))  # some picks per run: a bounded number
    return lists.join(classes.hint("merge"), "cls")


def _open(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """Large buckets of alike sets that hold more than one component so far: cls, key, m, out (not in the bucket's largest), visits (blocks of those)."""
    members = asked.select("cls", F.explode("buckets").alias("b")).where((F.col("b.m") > BLOCK) & F.col("b.dense")).select("cls", "b.key", "b.m")
    named = members.join(labels.withColumnRenamed("a", "cls").hint("merge"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = stored(named, "join-members")
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.ceil((F.sum("n") - F.max("n")) / BLOCK).cast("int").alias("visits"))
    mixed = stored(mixed.where("visits > 0"), "join-mixed")  # most buckets are one component, and go no further
    return stored(spread_join(named, mixed, "key", "inner").select("cls", "key", "m", (F.col("label") != F.col("main")).alias("out"), "visits"), "join-open")


def _labels(edges: DataFrame) -> DataFrame:
    """(a, b) -> (a, label): the least id of each connected component, by minimum over neighbours and pointer jumping."""
    # All of a large component have one label, so joins on labels are spread.
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "join-edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), "join-labels")
    while True:
        near = both.join(labels.withColumnRenamed("a", "b").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("near"))
        up = labels.select(F.col("a").alias("label"), F.col("label").alias("up"))
        one = spread_join(labels, up, "label", "left").join(near.hint("merge"), "a")
        new = stored(one.select("a", F.least("label", "near", "up").alias("label"), (F.least("label", "near", "up") < F.col("label")).alias("moved")), "join-labels")
        if not new.where("moved").limit(1).count():
            return new.select("a", "label")
        labels = new.select("a", "label")


def ngram_join(docs: DataFrame, threshold: float = 0.8, width: int = 5, target_recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """One row per input row: doc_id, class_id, group_id, n_links, n_shingles, and hashes of its text and of its group's least row.

    Words are maximal runs of word characters in lower case. class_id: the least id among rows with the same shingle set.
    n_links: other rows whose sets have Jaccard similarity of at least threshold (copies count); without `counts` it is null,
    and the same groups are found in work that grows with a dense bucket's size, not its square. group_id: the least id that
    links lead to. Texts without words (null, empty) link to nothing and are their own class and group. Rows that repeat an
    id are rows like any others; null ids count as less than all others in the work and come back as null. Other columns are
    ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    on_workers(spark)
    share = Fraction(threshold).limit_denominator(1000)
    runs = runs_for(target_recall)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            for some in _stretches(batch, 1):
                sets = shingles(some.column(1).to_pylist())
                marks = [_fingerprint(s) for s in sets]
                picks = _picks(sets, runs, threshold)
                yield pa.record_batch([some.column(0), some.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([h for h, _ in marks], pa.int64()), pa.array([x for _, x in marks], pa.int64()), picks], names=["doc", "text_hash", "n", "mark", "cls", "picks"])

    described = stored(hashed.mapInArrow(describe, "doc long, text_hash long, n long, mark long, cls long, picks array<array<long>>"), "join-described")
    with_words = described.where("n > 0")
    # The least row of a class by id, then by text, as ids (null ones too) may repeat.
    classes = with_words.groupBy("mark", "cls").agg(F.min(F.struct("doc", "text_hash")).alias("least"), F.count("*").alias("copies"))
    classes = stored(classes.select("mark", "cls", F.col("least.doc").alias("low"), F.col("least.text_hash").alias("low_hash"), "copies"), "join-classes")
    keys = ["mark", "cls"]
    # A class's picks come from its least row (one, where a row repeats).
    chosen = with_words.select("doc", "text_hash", *keys, "picks").join(classes.select(*keys, F.col("low").alias("doc"), F.col("low_hash").alias("text_hash")).hint("merge"), ["doc", "text_hash", *keys]).dropDuplicates(keys)

    asked = stored_alone(spark, lambda: _asked(chosen, classes, runs), "join-asked")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            for some in _stretches(batch, 0):
                sets = shingles(some.column(0).to_pylist())
                own = pa.array([_fingerprint(s) == (mark, cls) for s, mark, cls in zip(sets, some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)], pa.bool_())
                yield pa.record_batch([*some.columns[2:], pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "copies", "buckets", "tokens"]).filter(own)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The sets of classes in some bucket, from their texts; a row for each bucket of theirs."""
        texts = hashed.join(wanted.withColumnsRenamed({"low": "doc", "low_hash": "text_hash"}).hint("merge"), ["doc", "text_hash"])
        sets = texts.select("text", "mark", "cls", "copies", "buckets").mapInArrow(load, f"cls long, copies long, buckets {wanted.schema['buckets'].dataType.simpleString()}, tokens binary")
        keys = F.transform("buckets", lambda b: b["key"]) if counts else F.array().cast("array<long>")
        return sets.select("cls", "copies", "tokens", keys.alias("all_keys"), F.explode("buckets").alias("b")).withColumns({"key": F.col("b.key"), "blocks": F.ceil(F.col("b.m") / BLOCK).cast("int")})

    def block(salt: int) -> Column:
        return F.pmod(F.xxhash64("cls", "key", *([F.lit(salt)] if salt else [])), F.col("blocks")).cast("int")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j), own in _grouped(batches):
            ids, at = np.unique(np.array(own[0], np.int64), return_index=True)  # a row that repeats id and text comes once
            if len(ids) > 1:
                pick = lambda c: [own[c][k] for k in at.tolist()]  # noqa: B023, E731
                found = _compare(ids, np.array(pick(1), np.int64), [np.frombuffer(t, np.uint64) for t in pick(2)], [np.array(b, np.int64) for b in pick(3)], np.array(pick(4)), key, i, j, share)
                if len(found[0]):
                    yield pa.record_batch([pa.array(c) for c in found], names=["a", "links", "b"])

    def compared(tasks: DataFrame) -> DataFrame:
        """Rows (key, i, j, block, ...) to the tasks that compare them: all pairs where i = j, else those of different blocks."""
        dealt = tasks.select("key", "i", "j", "cls", "copies", "tokens", "all_keys", "block").repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
        return stored(dealt.mapInArrow(compare, "a long, links long, b long"), "join-links")

    spread = sets_of(asked)
    own = block(0)
    task = lambda i, j, b: F.struct(i.alias("i"), j.alias("j"), b.alias("block"))
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: task(F.least(own, o), F.greatest(own, o), own))
    if not counts:
        # Large buckets of alike sets: two deals to blocks, numbered one behind the other.
        deals = F.array(*(task(b, b, b) for b in (own, F.col("blocks") + block(1))))
        tasks = F.when(F.col("b.dense") & (F.col("blocks") > 1), deals).otherwise(tasks)
    linked = compared(spread.select("key", "cls", "copies", "tokens", "all_keys", F.inline(tasks)))
    links = linked.groupBy("a").agg(F.sum("links").alias("links"))
    labels = stored_alone(spark, lambda: _labels(linked.select("a", "b")), "join-labels")
    if not counts:
        parted = _open(asked, labels)
        if not parted.isEmpty():
            # Sets outside their bucket's largest component visit all its blocks, in visitors' blocks of their own.
            buckets = parted.groupBy("cls").agg(F.collect_list(F.struct("key", "m", "visits", "out")).alias("open"))
            again = sets_of(asked.drop("buckets").join(buckets.withColumnRenamed("open", "buckets").hint("merge"), "cls"))
            home, visits = block(0), F.col("b.visits")
            stay = F.transform(F.sequence(F.lit(1), visits), lambda v: task(home, F.col("blocks") + v, F.lit(0)))
            visitor = F.col("blocks") + F.pmod(F.xxhash64("cls", F.lit(2)), visits).cast("int") + 1  # never equal to a block's number
            others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != home)
            visit = F.when(F.col("b.out"), F.transform(others, lambda i: task(i, visitor, F.lit(1)))).otherwise(F.array().cast("array<struct<i:int,j:int,block:int>>"))
            tasks = again.select("key", "cls", "copies", "tokens", "all_keys", F.inline(F.concat(stay, visit)))
            more = compared(tasks)
            labels = stored_alone(spark, lambda: _labels(labels.select("a", F.col("label").alias("b")).union(more.select("a", "b"))), "join-labels")
    # Components are labelled with class numbers; their least document id comes from the classes in them.
    named = stored(labels.join(classes.select(F.col("cls").alias("a"), "low", "low_hash").hint("merge"), "a"), "join-named")
    lows = named.groupBy("label").agg(F.min(F.struct("low", "low_hash")).alias("group_least"))
    grouped = spread_join(named.select("a", "label"), stored(lows, "join-lows"), "label", "inner").join(links.hint("merge"), "a", "left")
    about = stored(classes.join(grouped.withColumnRenamed("a", "cls").hint("merge"), "cls", "left").select(*keys, "low", "copies", F.coalesce("group_least.low", "low").alias("group_low"), F.coalesce("group_least.low_hash", "low_hash").alias("group_hash"), F.coalesce("links", F.lit(0)).alias("links")), "join-classes")
    # One class may hold most rows, so this join is spread too.
    one = F.struct(*keys)
    full = spread_join(described.select("doc", "text_hash", "n", one.alias("both")), about.select(one.alias("both"), *(c for c in about.columns if c not in keys)), "both", "left")
    real = lambda c: F.when(c != _NO_ID, c)
    has = F.col("n") > 0
    return full.select(
        real(F.col("doc")).alias("doc_id"),
        real(F.when(has, F.col("low")).otherwise(F.col("doc"))).alias("class_id"),
        real(F.when(has, F.col("group_low")).otherwise(F.col("doc"))).alias("group_id"),
        (F.when(has, F.col("links") + F.col("copies") - 1).otherwise(0) if counts else F.lit(None)).cast("long").alias("n_links"),
        F.col("n").alias("n_shingles"),
        "text_hash",
        F.when(has, F.col("group_hash")).otherwise(F.col("text_hash")).alias("group_hash"),
    )


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, width: int = 5, target_recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The least row of each group, by id and then by its text's hash, with all its columns: one, unless id and text both repeat.

    Texts without words (null, empty) all stay. A null id counts as less than all others. Columns may have any names. An
    empty table stays empty.
    """
    name = fresh_name(docs, "near_key")
    key = lambda doc, text: F.concat_ws("/", F.coalesce(doc.cast("string"), F.lit("null")), text.cast("string"))
    found = ngram_join(docs, threshold, width, target_recall, id_col, text_col, counts=False)
    gone = found.where(~(F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("text_hash") == F.col("group_hash")))).select(key(F.col("doc_id"), F.col("text_hash")).alias(name)).distinct()
    keyed = docs.withColumn(name, key(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    return keyed.join(stored(gone, "join-gone").hint("merge"), name, "left_anti").select(*[docs[c] for c in docs.columns])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[list]]]:
    """Rows in (key, i, j) order -> each task's columns; a task is at most two blocks."""
    now: tuple[int, int, int] | None = None
    own: list[list] = [[] for _ in range(5)]
    for batch in batches:
        heads = list(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")), strict=True))
        columns = [batch.column(c).to_pylist() for c in ("cls", "copies", "tokens", "all_keys", "block")]
        for k, head in enumerate(heads):
            if head != now:
                if now is not None:
                    yield now, own
                now, own = head, [[] for _ in range(5)]
            for c in range(5):
                own[c].append(columns[c][k])
    if now is not None:
        yield now, own
