"""Exact, line and near-copy removal against brute force, with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import common, exact_dedup, line_dedup, ngram_join

#: Extra columns whose names the operators use inside.
EXTRA = "sha string, part int, run int, content_key string, cls long, near_key long, text_hash long, CONTENT_KEY_ string, _near_key int, _content_key string"
SCHEMA = f"doc_id long, text string, {EXTRA}"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1, 2, "k", 3, 4, 5, "y", 6, "z") for a, b in rows], SCHEMA)


def texts():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, ""), (None, ""), (None, "only null id"), (None, "a"), (7, "a"), (7, "a"), (8, "A"), (9, "a "), (10, "long " * 100_000), (11, "long " * 100_000)]
    rows += [(100 + i, rng.choice(["hot", "hot", f"t{rng.randint(0, 40)}", "héé\x00"])) for i in range(900)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    rows = texts()
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    out = exact_dedup.exact_dedup(frame(spark, rows), keep).collect()
    want = []
    for text, ids in groups.items():
        real = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(real) if real else None
        want += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(frame(spark, rows).limit(0), keep).count() == 0


def test_exact_dedup_spreads_equal_rows(spark, monkeypatch):
    """Thousands of rows that are equal in id (null) and text are one group over several tasks."""
    kept, stored = [], exact_dedup.stored
    monkeypatch.setattr(exact_dedup, "stored", lambda df, what: kept.append(stored(df, what)) or kept[-1])
    out = exact_dedup.exact_dedup(frame(spark, [(None, "the same")] * 6000 + [(5, "other")]).repartition(4))
    assert out.select("keep_id", "group_size", "kept").distinct().orderBy("group_size").collect() == [(5, 1, True), (None, 6000, True)]
    sizes = [r["count"] for r in kept[0].groupBy("part").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 3000


def test_exact_dedup_keeps_rows(spark):
    rows = texts()
    stays = exact_dedup.drop_copies(frame(spark, rows), "smallest")
    assert stays.columns == frame(spark, rows[:1]).columns
    best = {}
    for doc, text in rows:
        best.setdefault(text or "", []).append(doc)
    want = Counter((min((i for i in ids if i is not None), default=None), t) for t, ids in best.items())
    out = stays.collect()
    assert Counter((r.doc_id, r.text or "") for r in out) == want
    assert all(r.content_key == "k" and r.CONTENT_KEY_ == "y" and r._content_key == "z" for r in out)


def line_rule(rows):
    held = defaultdict(set)
    norm = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    rank = lambda d: (d is not None, d or 0)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[norm(line)].add(rank(doc))
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(norm(x)) < 10 or min(held[norm(x)]) == rank(doc)]
        yield doc, len(lines), len(lines) - len(kept), "\n".join(kept)


def test_line_dedup(spark):
    rng = random.Random(4)
    pool = ["", "short", "a line that is shared", " A LINE that is shared\t", "ÀÉ çà et là encore", "\x0bexactly10c\r", "x" * 9, "é" * 10] + [f"line number {i}" for i in range(60)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(300)] + [(None, "a line that is shared\nnull row"), (900, None), (901, ""), (902, "\n"), (903, "\n".join(pool * 300))]
    docs = frame(spark, rows)
    out = line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, out), key=str) == sorted(line_rule(rows), key=str)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_rows_that_share_an_id(spark):
    """Each row of an id has its own bitmap; equal rows share one; null ids are one document."""
    shared = "a line that is shared"
    rows = [(1, shared), (2, f"{shared}\nsecond text of two"), (2, f"a unique line only here\n{shared}"), (2, f"{shared}\nsecond text of two"), (3, f"second text of two\nnew in three\n{shared}\n{shared}")]
    rows += [(None, f"null one here\n{shared}"), (None, f"{shared}\nnull one here"), (None, None), (4, "null one here\nfour has this")] * 2
    rng = random.Random(6)
    pool = [f"line number {i}" for i in range(25)]
    rows += [(rng.randint(10, 30), "\n".join(rng.choices(pool, k=rng.randint(1, 9)))) for _ in range(200)]
    out = line_dedup.line_dedup(frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, out), key=str) == sorted(line_rule(rows), key=str)


def test_hot_line_is_decided_by_counts(spark):
    rows = [(i, f"one very common line\nown line {i} of text") for i in range(2000)]
    out = line_dedup.line_dedup(frame(spark, rows)).agg(F.sum("n_dropped"), F.count("*")).first()
    assert tuple(out) == (1999, 2000)


def brute_links(rows, num=4, den=5):
    sets = []
    for _, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) * (num + den) >= num * (len(sets[i]) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    rank = lambda d: (d is not None, d or 0)
    groups, classes = defaultdict(list), defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].append(doc)
        classes[sets[i] or i].append(doc)
    return [(doc, min(classes[sets[i] or i], key=rank), min(groups[find(i)], key=rank), links[i]) for i, (doc, _) in enumerate(rows)]


def near_rows(seed, base_words=60, copies=150):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 4000)}"
    passage = [word() for _ in range(55)]
    rows = []
    base = [word() for _ in range(base_words)]
    for i in range(copies):  # a large group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 + i, " ".join(w)))
    for i in range(120):  # a passage that many documents share
        rows.append((2000 + i, " ".join([word() for _ in range(rng.randint(20, 200))] + passage)))
    for i in range(60):  # pairs about the threshold
        w = [word() for _ in range(rng.randint(5, 120))]
        v = list(w)
        for _ in range(rng.randint(0, 1 + len(w) // 20)):
            v[rng.randrange(len(v))] = word()
        rows += [(3000 + 2 * i, " ".join(w)), (3001 + 2 * i, "! ".join(v).upper())]
    rows += [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "One!"), (6, "a b c d"), (7, "a b c d e"), (8, "a b c d e"), (8, "a b c d e"), (9, "the same " * 30_000), (None, "a b c d")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rows = near_rows(seed)
    out = ngram_join.ngram_join(frame(spark, rows), 0.8, 5, 0.9999).select("doc_id", "class_id", "group_id", "n_links").collect()
    assert sorted(map(tuple, out), key=str) == sorted(brute_links(rows), key=str)


def test_ngram_join_recall(spark):
    rows = [r for s in range(10, 13) for r in near_rows(s, copies=30)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want = sum(n for *_, n in brute_links(rows))
    got = ngram_join.ngram_join(frame(spark, rows), 0.8, 5, 0.95).agg(F.sum("n_links")).first()[0]
    assert 0.95 * want <= got <= want


def split_rows(n_pairs=1500, words=200, size=40):
    """Pairs at 0.8 exactly (32 of 40 words), all from so few words that each pick is in hundreds of texts, two picks in over 64."""
    rng = random.Random(8)
    rows = []
    for i in range(n_pairs):
        own = rng.sample(range(words), size)
        rows += [(2 * i, " ".join(f"w{k}" for k in own)), (2 * i + 1, " ".join(f"w{k}" for k in own[: size * 4 // 5]))]
    return rows


def test_ngram_join_split_twice(spark):
    rows = split_rows()
    held = np.zeros((len(rows), 200), np.int32)
    for i, text in rows:
        held[i, [int(w[1:]) for w in text.split()]] = 1
    # Buckets of one word and of two hold over 64 texts, which aren't alike: they split twice.
    together = held.T @ held
    assert np.diag(together).min() > 64 and np.median(together) > 64
    common, sizes = held @ held.T, held.sum(axis=1)
    similar = 9 * common >= 4 * (sizes[:, None] + sizes[None, :])
    want = similar.sum(axis=1) - 1
    out = ngram_join.ngram_join(frame(spark, rows), 0.8, 1, 0.9999).select("doc_id", "n_links").collect()
    got = np.array([n for _, n in sorted(map(tuple, out))])
    assert (got <= want).all()
    assert (want - got).sum() <= 2  # one pair: 0.15 are expected of 1,500


@pytest.mark.parametrize("target", [0.9, 0.99, 0.999])
@pytest.mark.parametrize("sizes", [(100, 80, 80), (90, 90, 80), (10, 8, 8)])
def test_ngram_join_runs_reach_recall(sizes, target):
    """A pair at the threshold shares a pick on each level of some run with the target chance."""
    a, b, both = sizes
    rng = np.random.default_rng(9)
    runs = ngram_join.runs_for(target)
    levels, n, met = ngram_join.LEVELS, 3000, 0
    for _ in range(n):
        tokens = rng.integers(0, 2**63, a + b - both, dtype=np.uint64)
        x, y = ngram_join._picks([np.sort(t) for t in (tokens[:a], tokens[a - both :])], runs, 0.8).to_pylist()
        through = [not set(p).isdisjoint(q) for p, q in zip(x, y, strict=True)]
        met += any(all(through[r * levels : (r + 1) * levels]) for r in range(runs))
    assert met / n >= target - 3 * (target * (1 - target) / n) ** 0.5


def test_picks_of_many_sets_are_those_of_each():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 1, 3, 50, 0, 4000)]
    got = ngram_join._picks(sets, 5, 0.8).to_pylist()
    for s, lists in zip(sets, got, strict=True):
        assert len(lists) == 5 * ngram_join.LEVELS
        for k, own in enumerate(lists):
            h = ngram_join._mixed(s * ngram_join.PICKS[k])
            limit = min(2**64 - 1, int((ngram_join.DEEPER if k % ngram_join.LEVELS else ngram_join.PICKED) * 2**64 / (0.8 * max(len(s), 1))))
            want = sorted((int(x), int(t)) for x, t in zip(h, s.view(np.int64), strict=True) if int(x) <= limit)
            assert own == [t for _, t in want]
    assert ngram_join._picks([], 5, 0.8).to_pylist() == []


def test_ngram_join_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rows = near_rows(5, copies=90)
    out = ngram_join.ngram_join(frame(spark, rows), 0.8, 5, 0.9999).select("doc_id", "class_id", "group_id", "n_links").collect()
    assert sorted(map(tuple, out), key=str) == sorted(brute_links(rows), key=str)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, how):
    rows = [(1, i, "hot") for i in range(4000)] + [(k, k, "x") for k in range(2, 200)] + [(None, 0, "null")]
    left = spark.createDataFrame(rows, "k long, i long, HOT string")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(1, 150)], "k long, r string")
    want = left.join(right, "k", how).collect()
    assert sorted(map(str, common.spread_join(left, right, "k", how).collect())) == sorted(map(str, want))
    assert common.spread_join(left.limit(0), right, "k", how).count() == 0


def test_near_copies_without_own_ids(spark):
    """Near copies whose ids are all null, or all the same, leave one row of each group."""
    rng = random.Random(12)
    rows, group = [], {}
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 4000)}" for _ in range(80)]
        for k in range(6):
            text = " ".join([*base, f"end{k}"])
            rows.append((None if g < 6 else 50 + g, text))
            group[text] = g
    out = ngram_join.drop_near_copies(frame(spark, rows))
    assert out.select("near_key", "_near_key").distinct().collect() == [(4, 6)]
    out = out.select("doc_id", "text").collect()
    assert sorted(group[t] for _, t in out) == list(range(12))
    found = ngram_join.ngram_join(frame(spark, rows)).select("doc_id", "class_id", "group_id", "n_links").collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute_links(rows), key=str)


def test_ngram_join_empty(spark):
    docs = frame(spark, [(1, "x")])
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0
    assert ngram_join.drop_near_copies(docs.limit(0)).count() == 0
    assert ngram_join.drop_near_copies(docs).columns == docs.columns


def _near_group(n, words, edits, seed, base=0):
    """Texts that differ from one base by a few words each."""
    rng = random.Random(seed)
    text = [f"w{base}x{i}" for i in range(words)]
    out = []
    for k in range(n):
        own = list(text)
        for _ in range(edits):
            own[rng.randrange(words)] = f"e{base}y{k}z{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_groups_of_dense_buckets_without_all_pairs(spark, monkeypatch):
    """Blocks of 40 sets: a large group of near copies, one whose members link through chains only, and strangers among them."""
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    texts = _near_group(500, 120, 1, 1) + _near_group(300, 60, 2, 2, base=1)
    chain = [f"c{i}" for i in range(100)]
    for k in range(150):  # each link of the chain differs from the last by two words at its end and start
        texts.append(" ".join([f"c{i}" for i in range(2 * k, 100 + 2 * k)]))
    texts += [f"alone {i} " + " ".join(f"s{i}t{j}" for j in range(30)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    exact = {r.doc_id: r.group_id for r in ngram_join.ngram_join(docs).collect()}
    fast = ngram_join.ngram_join(docs, counts=False).collect()
    assert {r.doc_id: r.group_id for r in fast} == exact
    assert {r.n_links for r in fast} == {None}
    assert len(set(exact.values())) < 400 and len(chain) == 100
    kept = {r.doc_id for r in ngram_join.drop_near_copies(docs).collect()}
    assert kept == set(exact.values())
