"""Toxic passages by maximum-scoring segments of token log-odds.

Each token scores the log-odds of toxic against clean labelled texts under Dirichlet priors. The priors are hierarchical: a
word's prior is its longest known prefix, whose prior is the next shorter one, so a word never seen is scored by its stem. A
linear-time scan (Ruzzo and Tompa, 1999) finds all maximal segments of a text. Segment scores of clean texts follow an
extreme-value law (Karlin and Altschul, 1990, 1993), which turns a text's segments into one significance, and that into a
probability by a logistic fit on labelled texts that the counts did not come from.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import on_workers
from .labelled import Logistic, training_rows

#: At most so many labelled documents: the bound on what fitting gathers. All their words and prefixes make the model.
MAX_ROWS = 20_000
#: Prefix lengths, documents a node must be in, pseudo-documents of a prior, what each token costs, and the least E-value that is reported.
SHORTEST, LONGEST, MIN_DOCS, STRENGTH, COST, MAX_E = 2, 10, 4, 4.0, 1.5, 0.05
#: Words whose scores a worker keeps, and characters of text that it takes apart at a time.
KEPT_WORDS, AT_ONCE = 200_000, 1 << 20

WORDS = re.compile(r"\w+").findall


def segments(scores: list[float] | np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive, in linear time.

    Only positive scores can begin or end a segment, so the scan runs over them; sums between come from running totals.
    """
    values = np.asarray(scores, float)
    total = np.concatenate([[0.0], np.cumsum(values)])
    out: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    linked: list[int] = []  # for each, the nearest earlier one with a smaller total before it
    for i in np.flatnonzero(values > 0).tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = linked[j]
            if j < 0 or out[j][3] >= right:
                out.append((start, end, left, right))
                linked.append(j)
                break
            start, left = out[j][0], out[j][2]
            del out[j:], linked[j:]
    return [(s, e, r - x) for s, e, x, r in out]


class ToxicityModel:
    """Log-odds of words and prefixes by their hash (12 bytes each), and the two calibrations."""

    def __init__(self, nodes: np.ndarray, odds: np.ndarray) -> None:
        """nodes: ascending 64-bit hashes, as node_hash gives them."""
        self.nodes, self.odds = nodes, odds
        self.rate, self.size = 1.0, 0.1  # lambda and K of the extreme-value law
        self.calibration: Logistic | None = None

    def words(self, words: list[str]) -> list[float]:
        """Each word's score: the odds of its own node, or of its longest prefix that has one, less the cost of a token."""
        out = np.full(len(words), -COST)
        left = list(range(len(words)))
        for shorter in range(-1, LONGEST):
            hashes, own = [], []
            for i in left:
                w = words[i]
                n = min(len(w), LONGEST) - shorter
                if shorter < 0 or n >= SHORTEST:
                    hashes.append(node_hash(w + "$" if shorter < 0 else w[:n]))
                    own.append(i)
            if not own:
                break
            at, found = _lookup(self.nodes, np.array(hashes, np.int64))
            out[np.array(own)[found]] += self.odds[at[found]]
            left = np.array(own)[~found].tolist()
        return out.tolist()

    def evidence(self, n_tokens: int, scores: list[float]) -> float:
        """-log p of a text's best segments: sums of the r largest normalised scores, the best r (Karlin and Altschul, 1993)."""
        norm = sorted((self.rate * s - math.log(self.size * max(n_tokens, 1)) for s in scores), reverse=True)
        best = total = 0.0
        for r, x in enumerate(norm, 1):
            total += x
            if x <= 0:
                break
            best = max(best, total - (r - 1) * math.log(max(total, 1e-9)) + math.lgamma(r + 1) + math.lgamma(r))
        return best


def node_hash(node: str) -> int:
    """The hash that Spark's xxhash64 gives, as a signed number."""
    x = xxhash.xxh64_intdigest(node.encode("utf-8", "replace"), 42)
    return x - (1 << 64) if x >> 63 else x


def _lookup(nodes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes among ascending nodes, and which of them are there."""
    at = np.minimum(np.searchsorted(nodes, hashes), max(len(nodes) - 1, 0))
    return at, nodes[at] == hashes if len(nodes) else np.zeros(len(hashes), bool)


def _node_odds(node: np.ndarray, parent: np.ndarray, depth: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of nodes -> hashes and log-odds, parents first. Nodes that tell nothing beyond their parent are left out.

    Each node's parent is here too, as it is in all documents that its nodes are in; a parent of 0 is the root.
    """
    order = np.argsort(node)
    node, parent, depth, toxic, clean = (x[order] for x in (node, parent, depth, toxic.astype(float), clean.astype(float)))
    up, has = _lookup(node, parent)
    full, own = np.zeros(len(node)), np.zeros(len(node), bool)
    told = np.zeros(len(node))  # what the model says of a node: its odds, or those of the nearest kept node above
    for level in np.unique(depth):
        at = np.flatnonzero(depth == level)
        inner, above = has[at], up[at]
        t, c = toxic[at], clean[at]
        up_t, up_c = np.where(inner, toxic[above], n_toxic), np.where(inner, clean[above], n_clean)
        share = STRENGTH * (t + c) / np.maximum(np.maximum(up_t + up_c, t + c), 1)
        full[at] = np.clip(np.where(inner, full[above], 0.0) + np.log((t + share) / (up_t + STRENGTH)) - np.log((c + share) / (up_c + STRENGTH)), -6.0, 6.0)
        near = np.where(inner, told[above], 0.0)
        own[at] = np.abs(full[at] - near) > 0.05
        told[at] = np.where(own[at], full[at], near)
    return node[own], full[own].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, learn_from, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Learn from at most max_rows labelled documents: counts from three folds of four, calibrations from the other.

    Null labels and ids are left out, null texts count as empty, rows that repeat a labelled id all count. Without labelled
    documents, or with one class only, each text's score is that class's share. Other columns are ignored.
    """
    on_workers(docs.sparkSession)
    rows = training_rows(docs, labels, "toxic", learn_from, max_rows)
    counted = rows.where("fold > 0")
    sizes = {r.label: r.n for r in counted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    words = counted.select("label", "text").mapInArrow(_distinct_words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST)))
    prefixes = F.when(F.length("word") >= SHORTEST, F.transform(lengths, lambda n: F.substr(F.col("word"), F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    nodes = words.select(F.explode(F.concat(prefixes, F.array(F.concat("word", F.lit("$"))))).alias("node"), "t", "c").groupBy("node").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    is_word, size = F.endswith("node", F.lit("$")), F.length("node")
    above = F.when(is_word, F.substr("node", F.lit(1), F.least(size - 1, F.lit(LONGEST)))).otherwise(F.substr("node", F.lit(1), size - 1))
    known = nodes.where(F.col("t") + F.col("c") >= MIN_DOCS).select(
        F.xxhash64("node").alias("node"), F.when(F.length(above) >= SHORTEST, F.xxhash64(above)).otherwise(0).alias("parent"), F.when(is_word, LONGEST + 1).otherwise(size).alias("depth"), "t", "c"
    )
    # Five numbers for each node of max_rows documents.
    columns = known.toArrow()
    counts = [columns.column(n).to_numpy() for n in ("node", "parent", "depth", "t", "c")]
    model = ToxicityModel(*_node_odds(*counts, sizes.get(1, 0), sizes.get(0, 0)))

    seen = _scan(rows.where("fold = 0").select(F.col("label").alias("doc_id"), "text"), model).collect()  # max_rows rows at most
    clean = [r for r in seen if r.doc_id == 0]
    _extreme_value_law(model, clean)
    x = np.array([(model.evidence(r.n_tokens, r.scores), math.log1p(r.n_tokens)) for r in seen], float).reshape(-1, 2)
    model.calibration = Logistic(_features(x), np.array([r.doc_id for r in seen], float))
    return model


def _extreme_value_law(model: ToxicityModel, clean: list) -> None:
    """lambda solves sum p(s) exp(lambda s) = 1 over the token scores of clean texts; K fits their best segments' mean."""
    tally: dict[float, int] = {}
    for r in clean:
        for s, n in zip(r.values, r.counts, strict=True):
            tally[s] = tally.get(s, 0) + n
    if tally and max(tally) > 0 and sum(s * n for s, n in tally.items()) < 0:
        s, p = np.array(list(tally)), np.array(list(tally.values()), float)
        p /= p.sum()
        low, high = 1e-4, 1.0
        while (p * np.exp(np.minimum(high * s, 700))).sum() < 1 and high < 50:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (low, mid)
        model.rate = low
    best = [model.rate * max(r.scores) - math.log(r.n_tokens) for r in clean if r.scores]
    if best:
        model.size = float(np.clip(math.exp(np.mean(best) - 0.5772), 1e-4, 10))


def _features(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.sqrt(x[:, 0]), x[:, 0], x[:, 1], np.sqrt(x[:, 0]) * x[:, 1], x[:, 0] > 0])


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tally: dict[str, list[int]] = {}
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in set(WORDS(text.lower())):
                tally.setdefault(w, [0, 0])[label] += 1
        yield pa.record_batch([pa.array(list(tally), pa.string()), pa.array([n[1] for n in tally.values()], pa.int64()), pa.array([n[0] for n in tally.values()], pa.int64())], names=["word", "toxic", "clean"])


class Scorer:
    """Scores texts with a model; keeps the scores of words it has met."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.known = model, {}

    def scores(self, texts: Iterator[str]) -> Iterator[list[float]]:
        """Each text's word scores, some texts at a time. A word that repeats the one before it tells nothing new and only costs."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(WORDS(text.lower()))
            size += len(text)
            if size >= AT_ONCE:
                yield from self._scored(held)
                held, size = [], 0
        yield from self._scored(held)

    def _scored(self, held: list[list[str]]) -> Iterator[list[float]]:
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known = self.known
        new = list(set().union(*held).difference(known))
        known.update(zip(new, self.model.words(new), strict=True))
        for words in held:
            yield [-COST if w == before else known[w] for w, before in zip(words, ["", *words], strict=False)]


def _texts(column: pa.Array) -> Iterator[str]:
    return (t.as_py() or "" for t in column)


def _scan(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """Segment scores of each text, with a tally of its token scores."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # 12 bytes a node of at most max_rows documents

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for batch in batches:
            out = []
            for doc, scores in zip(batch.column(0).to_pylist(), own.scores(_texts(batch.column(1))), strict=True):
                values, counts = np.unique(np.round(scores, 1), return_counts=True)
                out.append((doc, len(scores), [s for _, _, s in segments(scores)], values.tolist(), counts.tolist()))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "n_tokens", "scores", "values", "counts"])

    return rows.mapInArrow(scan, "doc_id long, n_tokens long, scores array<double>, values array<double>, counts array<long>")


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_tokens, passages: the probability that each whole text is toxic, and its significant passages.

    passages: array of (start, end, e_value), token numbers with end exclusive, E-value of MAX_E at most. Null texts count as
    empty; texts without words share one score. Repeated rows are scored alike. Other columns are ignored.
    """
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        m = own.model
        passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("e_value", pa.float64())]))
        for batch in batches:
            sizes, evidence, passages = [], [], []
            for values in own.scores(_texts(batch.column(1))):
                found = segments(values)
                n = len(values)
                sizes.append(n)
                evidence.append((m.evidence(n, [s for _, _, s in found]), math.log1p(n)))
                e_values = [(a, b, m.size * n * math.exp(max(-700.0, -m.rate * s))) for a, b, s in found]
                passages.append([{"start": a, "end": b, "e_value": e} for a, b, e in e_values if e <= MAX_E])
            p = m.calibration(_features(np.array(evidence, float).reshape(-1, 2)))
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array(sizes, pa.int64()), pa.array(passages, passage)], names=["doc_id", "score", "n_tokens", "passages"])

    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(scores, "doc_id long, score double, n_tokens long, passages array<struct<start:int,end:int,e_value:double>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores under the threshold, with all their columns; no row moves.

    Null texts are scored as empty and come back null; rows that repeat go or stay together. An empty table stays empty.
    """
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        m = own.model
        for batch in batches:
            if batch.num_rows:
                evidence = [(m.evidence(len(v), [s for _, _, s in segments(v)]), math.log1p(len(v))) for v in own.scores(_texts(batch.column(at)))]
                yield batch.filter(pa.array(m.calibration(_features(np.array(evidence, float).reshape(-1, 2))) < threshold))

    return docs.mapInArrow(clean, docs.schema)
