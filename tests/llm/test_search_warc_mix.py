"""Top-k search, WARC archives and mixing against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import mixing, topk, warc


def brute_top(rows, k, every):
    good = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % every == 0:
            ranked = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q))[:k]
            out += [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(ranked, 1)]
    return out


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_top_k(spark, spread):
    rng = np.random.default_rng(7)
    rows = [(int(i), rng.normal(0, spread, 12).astype("f4").tolist()) for i in range(0, 700)]
    rows += [(10_000 + i, rows[50][1]) for i in range(200)]  # many equal vectors
    rows += [(20_000, None), (20_050, [None] * 12), (20_100, [float("nan")] * 12), (20_150, [float("inf")] * 12), (None, rows[0][1]), (20_200, [1.0]), (20_250, [0.0] * 12)]
    docs = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, block int, part int, v int")
    got = topk.top_k(docs, 5, 50).collect()
    assert sorted(map(tuple, got)) == sorted(brute_top(rows, 5, 50))


def test_top_k_mixed_lengths_and_huge_values(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 300)
    rng = random.Random(11)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-3, 3) for _ in range(rng.randint(0, 6))]) for i in range(500)]
    rows += [(1000 + i, [rng.choice([-1, 1]) * 10.0 ** rng.uniform(8, 307) for _ in range(rng.randint(1, 4))]) for i in range(120)]
    rows += [(2000, [1.7e308, 1.7e308]), (2001, [1.7e308, 1.7e308]), (2050, [-1.7e308] * 2), (2100, [2.0**31, 2.0**31]), (2101, [2.0**24]), (2102, [0.0, 1.0])]
    rows += [(3, rows[0][1]), (50, rows[1][1]), (50, rows[50][1])]  # repeated ids, one a query's
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    first = min(rows[50][1], rows[1][1])
    asked = [(i, v) for i, v in rows if i != 50 or v == first]
    want = [r for r in brute_top(rows, 5, 50) if r[0] != 50] + [r for r in brute_top(asked, 5, 50) if r[0] == 50]
    assert sorted(map(tuple, topk.top_k(docs, 5, 50).collect())) == sorted(set(want))


def test_top_k_small(spark):
    docs = spark.createDataFrame([(0, [1.0, -2.0]), (3, [0.5, 0.5]), (4, [0.5, 0.5])], "vec_id long, embedding array<float>")
    score = 256 * 128 - 512 * 128
    assert sorted(map(tuple, topk.top_k(docs, 5, 50).collect())) == [(0, 1, 3, score), (0, 2, 4, score)]
    assert topk.top_k(docs.limit(0)).count() == 0


def test_warc(spark):
    big, shared = "é" * 700, "<p>shared</p>" * 100
    rows = [(1, "http://a/ b\r\nX: y", shared), (2, None, shared), (3, "http://c", shared), (None, "http://n", shared), (4, "u", None), (5, "u", ""), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "u", big), (9, "u", big), (9, "u", big), (10, "u", "a\r\n\r\nb\x00" * 400), (11, "u", "long " * 300_000)]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, payload string, offset long")
    best = defaultdict(list)
    for page, _, html in rows:
        best[html or ""].append(page)
    want = []
    for page, _, html in rows:
        data, ids = (html or "").encode(), best[html or ""]
        top = max(i for i in ids if i is not None)
        again = len(data) >= 1000 and page != top
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None, None if again else html or ""))
    got = warc.round_trip(pages).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_hot_payload(spark):
    """A payload of most pages is decided by counts, others by their digests."""
    rows = [(i, "same " * 300 if i % 3 else f"pair {i // 6} " * 200) for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u"))
    top = {}
    for i, html in rows:
        top[html] = max(i, top.get(html, 0))
    want = [(i, None if top[html] == i else top[html]) for i, html in rows]
    assert sorted((r.page_id, r.refers_to) for r in warc.round_trip(pages).select("page_id", "refers_to").collect()) == want


def test_warc_equal_digests_of_different_payloads(spark):
    """Payloads that share SHA-1 and size, but not the second digest, don't revisit each other."""
    thin = [(1, "d", 7, 2000), (2, "d", 8, 2000), (3, "d", 7, 2000), (4, "d", 8, 2000), (5, "d", 9, 2000), (6, "e", 1, 10), (7, "e", 1, 10)]
    rows = spark.createDataFrame(thin, "page_id long, payload_digest string, payload_mix long, payload_bytes long")
    assert sorted(map(tuple, warc.revisits(rows, 1000).collect())) == [(1, "d", 7, 3), (2, "d", 8, 4)]


def test_warc_selected_ranges(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * (i % 50 + 1)) for i in range(500)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}"
    index = warc.write_warc(pages, folder)
    got = warc.read_warc(index.where("page_id % 7 = 0"), folder).collect()
    assert sorted((r.page_id, r.payload) for r in got) == [(i, f"page {i} " * (i % 50 + 1)) for i in range(0, 500, 7)]


def test_coalesced_ranges():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.GAP + 1, 5), ("b", 0, 7)]
    assert list(warc._coalesced(iter(rows))) == [("a", [(0, 10), (10, 5)]), ("a", [(15 + warc.GAP + 1, 5)]), ("b", [(0, 7)])]


def corpus(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k", 3, 4) for r in rows], "doc_id long, text string, source string, block int, size int, take_key string, _take_key int, TIMES int")


def weights(tokens, exponent):
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    return {s: x / math.fsum(raised.values()) for s, x in raised.items()}


def entropy(shares):
    some = [x for x in shares.values() if x > 0]
    return -math.fsum(x * math.log(x) for x in some) / math.log(len(some)) if len(some) > 1 else 1.0


def cover(tokens, shares):
    return max(n / shares[s] for s, n in tokens.items() if n)


def least_exponent(good):
    low, high = 0.0, 1.0
    if good(low):
        return low
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


@pytest.mark.parametrize("seed", range(2))
def test_solve_against_plain_bisection(spark, seed):
    """Exponents, entropy and budgets from sums over the table of sources, against dictionaries."""
    rng = random.Random(seed)
    tokens = {f"s{i}": int(10 ** rng.uniform(0, 7)) for i in range(rng.choice([1, 2, 40]))} | {"none": 0}
    table = spark.createDataFrame(list(tokens.items()), "src string, tokens long")
    for e in (0.0, 0.3, 1.0):
        t, shares = mixing.temperatures(table, [e])[0], weights(tokens, e)
        assert math.isclose(t.entropy, entropy(shares), abs_tol=1e-9) and math.isclose(t.cover, cover(tokens, shares), rel_tol=1e-9)
        assert math.isclose(t.repeats(12345), max(shares[s] * 12345 / n for s, n in tokens.items() if n), rel_tol=1e-9)
    for budget, target, most in ((None, None, 3.0), (None, 0.8, None), (10**6, 0.9, 5.0), (10**12, None, 2.0), (None, None, None)):

        def good(e):
            shares = weights(tokens, e)
            whole = cover(tokens, shares) if budget is None else budget
            return (target is None or entropy(shares) <= target) and (most is None or max(shares[s] * whole / n for s, n in tokens.items() if n) <= most)

        assert abs(mixing.solve(table, budget, target, most).exponent - least_exponent(good)) < 1e-8


def mix_rows():
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 30), "big") for i in range(3000)]
    rows += [(5000 + i, "v\n" * rng.randint(1, 30), f"s{i % 4}") for i in range(400)]
    return rows + [(9000, None, "big"), (9001, "", None), (9002, "three words here", None), (None, "no id", "s1"), (9003, None, "silent"), (9004, "twice", "s2"), (9004, "twice", "s2")]


@pytest.mark.parametrize("small", [False, True])
def test_mix_weights_and_blocks(spark, monkeypatch, small):
    """Also with so few blocks to a chunk, documents to a block and sources to a broadcast that all steps have several."""
    if small:
        monkeypatch.setattr(mixing, "BLOCK_DOCS", 20)
        monkeypatch.setattr(mixing, "CHUNK_BLOCKS", 7)
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = mix_rows()
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len((text or "").split())
    out = mixing.mix(corpus(spark, rows), target_entropy=None, max_repeats=3.0).collect()
    named = {str(s): n for s, n in tokens.items()}
    most = lambda e: (w := weights(named, e)) and max(w[s] * cover(named, w) / n for s, n in named.items() if n)
    exponent = least_exponent(lambda e: most(e) <= 3.0)
    shares = weights(named, exponent)
    budget = cover(named, shares)
    assert abs(most(exponent) - 3.0) < 1e-6
    got, by_doc = Counter(), defaultdict(list)
    for r in out:
        got[str(r.source)] += r.n_tokens
        by_doc[(r.doc_id, r.source)].append(r.copy)
    for s, n in named.items():
        assert abs(got[s] - shares[s] * budget) <= 31, s
        if n == 0:
            assert got[s] == 0
    for (doc, source), copies in by_doc.items():
        assert sorted(set(copies)) == list(range(max(copies) + 1)) and 0 in copies, (doc, source)
    assert {(d, s) for d, _, s in rows} == set(by_doc)  # the covering budget takes all
    half = sorted((r for r in out), key=lambda r: r.place)
    seen = Counter()
    for r in half[: len(half) // 2]:
        seen[str(r.source)] += r.n_tokens
    total = sum(seen.values())
    assert all(abs(seen[s] / total - shares[s]) < 0.05 for s in named)


def test_mix_budget(spark):
    rows = mix_rows()
    named = Counter()
    for _, text, source in rows:
        named[str(source)] += len((text or "").split())
    out = mixing.mix(corpus(spark, rows), budget=5000, target_entropy=0.9, max_repeats=None).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    shares = weights(named, least_exponent(lambda e: entropy(weights(named, e)) <= 0.9))
    assert abs(entropy(shares) - 0.9) < 1e-6
    assert all(abs(r.n - 5000 * shares[str(r.source)]) <= 31 for r in out)


def test_mixed_rows(spark):
    docs = corpus(spark, mix_rows())
    out = mixing.mixed(docs, target_entropy=None, max_repeats=2.0)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {(r.doc_id, r.text) for r in docs.collect()}
    assert mixing.mixed(docs.limit(0), target_entropy=None, max_repeats=2.0).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_equal_rows_spread_over_blocks(spark):
    """6,000 rows alike, ids null, are six blocks of about a thousand, not one; each is taken once."""
    docs = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same words here").alias("text"), F.lit("s").alias("source"))
    sizes = [r["count"] for r in mixing.mix(docs).groupBy("block").count().collect()]
    assert len(sizes) == 6 and sum(sizes) == 6000 and max(sizes) < 1300


def test_very_many_passes(spark):
    """A one-word source beside large ones, without a limit on repeats: passes are ranges, and each pass takes the word once."""
    rows = [(i, "word " * 400, f"s{i % 3}") for i in range(300)] + [(1000, "word", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, target_entropy=1.0, max_repeats=None)
    tiny = out.where("source = 'tiny'").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("copies"), F.min("copy").alias("low"), F.max("copy").alias("high"), F.sum("n_tokens").alias("tokens")).first()
    other = out.where("source = 's1'").agg(F.sum("n_tokens")).first()[0]
    assert tiny.n == tiny.copies == tiny.high + 1 == tiny.tokens and tiny.low == 0 and tiny.n > mixing.RANGE
    assert abs(tiny.tokens - other) <= 400


def plain_mix(rows, exponent, cover_budget):
    """Of each source: its tokens and the wanted ones, from plain sums."""
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len((text or "").split())
    shares = weights({str(s): n for s, n in tokens.items()}, exponent)
    return {s: (n, round(shares[str(s)] * cover_budget)) for s, n in tokens.items()}


def test_mix_rows_are_whole_passes_and_one_part(spark):
    """Every document comes once a whole pass, and the last pass ends with the document that reaches the source's budget."""
    rows = mix_rows()
    out = mixing.mix(corpus(spark, rows), target_entropy=None, max_repeats=3.0)
    named = Counter()
    for _, text, source in rows:
        named[str(source)] += len((text or "").split())
    most = lambda e: (w := weights(named, e)) and max(w[s] * cover(named, w) / n for s, n in named.items() if n)
    exponent = least_exponent(lambda e: most(e) <= 3.0)
    plan = plain_mix(rows, exponent, cover(named, weights(named, exponent)))
    words = {(d, s): len((t or "").split()) for d, t, s in rows}
    per = defaultdict(lambda: defaultdict(list))
    for r in out.collect():
        per[r.source][r.copy].append(r)
    for source, (have, want) in plan.items():
        copies = per[source]
        ids = sorted(((d, s) for d, _, s in rows if s == source), key=str)
        whole = want // have if have else 1
        for copy in range(min(whole, max(copies) + 1)):
            if copy < whole:
                assert sorted(((r.doc_id, r.source) for r in copies[copy]), key=str) == ids, (source, copy)
        taken = sum(r.n_tokens for own in copies.values() for r in own)
        assert abs(taken - want) <= max(words[k] for k in ids) + 1, source
