"""Held-out accuracy of the two classifiers, and the parts that can be checked exactly."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import quality, toxicity
from sensorloom.llm.common import crc32_mod
from sensorloom.llm.labelled import Logistic, training_rows

SF = "/root/testdata/sf0.01"
TOXIC_AUC, QUALITY_AUC = 0.93, 0.97


def held_out(spark, module, label, modulus, rest):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learn = (lambda d: crc32_mod(d, modulus) != rest)
    model = module.fit(docs, labels, learn)
    rows = module.score(docs, model).join(labels, "doc_id").where(crc32_mod(F.col("doc_id"), modulus) == rest).select("score", label).collect()
    return np.array([r.score for r in rows]), np.array([r[label] for r in rows])


def auc(score, label):
    rank = score.argsort().argsort()
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


def test_quality_held_out(spark):
    score, label = held_out(spark, quality, "quality", 5, 0)
    assert auc(score, label) > QUALITY_AUC
    assert ((score >= 0.3) == label).mean() > 0.9


def test_toxicity_held_out(spark):
    score, label = held_out(spark, toxicity, "toxic", 3, 1)
    assert auc(score, label) > TOXIC_AUC
    assert (score[label == 0] >= 0.7).mean() < 0.03


@pytest.mark.parametrize("seed", range(5))
def test_segments_are_maximal(seed):
    """Against the definition: repeatedly take the best segment, then look left and right of it."""
    rng = np.random.default_rng(seed)
    values = np.round(rng.normal(-0.3, 1, 60), 3)
    total = np.concatenate([[0], np.cumsum(values)])

    def best(lo, hi, out):
        found = max(((total[j] - total[i], -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
        if found and found[0] > 1e-9:
            out.append((found[2], found[3]))
            best(lo, found[2], out)
            best(found[3], hi, out)

    want = []
    best(0, len(values), want)
    assert sorted((a, b) for a, b, _ in toxicity.segments(values)) == sorted(want)
    assert toxicity.segments([]) == [] and toxicity.segments([-1.0, 0.0]) == []


def plain_odds(rows):
    """word or prefix -> log-odds, by the definition, on strings: [(label, text)] -> what a model says of a word."""
    t, total = toxicity, Counter(label for label, _ in rows)
    counts = defaultdict(lambda: [0, 0])
    for label, text in rows:
        for w in set(re.findall(r"\w+", text.lower())):
            for node in [w + "$", *(w[:k] for k in range(t.SHORTEST, min(len(w), t.LONGEST) + 1))]:
                counts[node][label] += 1
    counts = {n: c for n, c in counts.items() if sum(c) >= t.MIN_DOCS}

    def chain(word):
        """The nodes above a word and the word itself, from short to long."""
        return [n for n in [*(word[:k] for k in range(t.SHORTEST, min(len(word), t.LONGEST) + 1)), word + "$"] if n in counts]

    def score(word):
        above, odds, told = (total[0], total[1]), 0.0, 0.0
        for node in chain(word):
            own = counts[node]
            share = t.STRENGTH * sum(own) / max(sum(above), sum(own), 1)
            odds = max(-6.0, min(6.0, odds + math.log((own[1] + share) / (above[1] + t.STRENGTH)) - math.log((own[0] + share) / (above[0] + t.STRENGTH))))
            if abs(odds - told) > 0.05:
                told = odds
            above = own
        return told - t.COST

    return score


def test_toxicity_against_plain_version(spark):
    """Word scores, segments' evidence and scores of all documents, held against the definition on strings."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels, lambda d: crc32_mod(d, 3) != 1)
    rows = training_rows(docs, labels, "toxic", lambda d: crc32_mod(d, 3) != 1, toxicity.MAX_ROWS).collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in rows)
    word = plain_odds([(r.label, r.text) for r in rows if r.fold > 0])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        words = re.findall(r"\w+", texts[r.doc_id].lower())
        scores = [-toxicity.COST if i and w == words[i - 1] else word(w) for i, w in enumerate(words)]
        assert np.allclose([s for s, w in zip(model.words(words), words, strict=True)], [word(w) for w in words], atol=1e-5)
        found = toxicity.segments(np.float32(scores).astype(float))
        evidence = model.evidence(len(words), [x for *_, x in found])
        want = model.calibration(toxicity._features(np.array([[evidence, math.log1p(len(words))]])))[0]
        assert abs(r.score - want) < 1e-3 and r.n_tokens == len(words)
    assert model.rate > 0 and model.size > 0


def test_unseen_words_take_their_stem():
    names = ["ba", "bad", "go", "goo", "badword$", "good$"]
    parents = [None, "ba", None, "go", "bad", "goo"]
    table = [np.array([toxicity.node_hash(n) for n in names]), np.array([toxicity.node_hash(n) if n else 0 for n in parents]), np.array([2, 3, 2, 3, 11, 11]), np.array([50, 50, 1, 0, 20, 0]), np.array([0, 0, 80, 40, 0, 40])]
    model = toxicity.ToxicityModel(*toxicity._node_odds(*table, 60, 500))
    badness, gone, neutral = model.words(["badness", "gone", "neutral"])
    assert badness > 0 > gone and neutral == -toxicity.COST


def test_edge_rows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["nice", "day", "tree"] if i % 2 else ["awful", "day", "scum"], k=30)) + ("" if i % 2 else " ###"), "s", 1, 2) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(400)] + [(None, 1, 1), (3, None, None), (500, 1, 0)], "doc_id long, quality int, toxic int")
    rows += [(1000, None, "s", 1, 2), (1001, "", "s", 1, 2), (None, "scum " * 200_000, "s", 1, 2), (1002, "\n \t", "s", 1, 2), (1002, "\n \t", "s", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, label int, fold int")
    for module in (toxicity, quality):
        model = module.fit(docs, labels, lambda d: F.lit(True))
        out = {(r.doc_id, r.score) for r in module.score(docs, model).collect()}
        assert all(0 <= s <= 1 for _, s in out) and len({d for d, _ in out}) == len({r[0] for r in rows})
        by_id = dict(out)
        assert by_id[1000] == by_id[1001]
        assert module.score(docs.limit(0), model).count() == 0
        nothing = module.fit(docs, labels.limit(0), lambda d: F.lit(True))
        assert module.score(docs, nothing).count() == len(rows)
    tox = toxicity.fit(docs, labels, lambda d: F.lit(True))
    kept = toxicity.drop_toxic(docs, tox)
    assert kept.columns == docs.columns
    assert all(r.doc_id is None or r.doc_id >= 1000 or r.doc_id % 2 for r in kept.collect())  # one word over and over is one piece of evidence


def test_training_rows_stay_apart(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ids = [r.doc_id for r in training_rows(docs.withColumnRenamed("doc_id", "doc_id"), labels, "toxic", lambda d: crc32_mod(d, 3) != 1, 100).select("text", "label", "fold").join(docs, "text").select("doc_id").distinct().collect()]
    wanted = {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    assert len(ids) >= 90 and sum(i in wanted for i in ids) >= 90


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    p = 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))
    y = (rng.random(4000) < p).astype(float)
    assert np.abs(Logistic(x, y)(x) - p).mean() < 0.02
    assert 0 < Logistic(np.empty((0, 2)), np.empty(0))(x).min() < 1
