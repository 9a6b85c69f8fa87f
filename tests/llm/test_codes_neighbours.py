"""Vector codes and neighbour search against brute force."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorloom.llm import neighbours, vector_codes


def plain_codes(rows, parts, entries, rounds):
    """rows (vec_id, vector, label) -> {(vec_id, code, error, label_error)} counted, and the books."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    most = vector_codes.bound(parts, length)
    ints = [(i, tuple(max(-most, min(most, math.floor(256 * max(-1e300, min(1e300, x))))) for x in v) + (0,) * (parts * length - len(v)), label) for i, v, label in kept]
    ints.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    books = [[list(r[1][p * length : (p + 1) * length]) for r in ints[:entries]] for p in range(parts)]

    def assign():
        out = []
        for _, v, _ in ints:
            own = []
            for p in range(parts):
                x = v[p * length : (p + 1) * length]
                own.append(min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])))
            out.append(own)
        return out

    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, v, _), own in zip(ints, assign(), strict=True):
            for p, (_, k) in enumerate(own):
                groups[p, k].append(v[p * length : (p + 1) * length])
        for (p, k), xs in groups.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    final = assign()
    by = defaultdict(int)
    for (_, _, label), own in zip(ints, final, strict=True):
        by[label] += sum(d for d, _ in own)
    return sorted(((i, tuple(k for _, k in own), sum(d for d, _ in own), min(by[label], (1 << 63) - 1)) for (i, _, label), own in zip(ints, final, strict=True)), key=str), books


def check_codes(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).withColumns({c: F.lit(1) for c in ("x", "code", "part", "group", "n", "hot")})
    out, books = vector_codes.compress(df, **options)
    want, plain_books = plain_codes(rows, options["parts"], options["entries"], options["rounds"])
    assert sorted(((r.vec_id, tuple(r.code), r.error, r.label_error) for r in out.collect()), key=str) == want
    assert books.tolist() == plain_books
    flat = ",".join(str(v) for b in plain_books for e in b for v in e)
    assert vector_codes.books_digest(books) == hashlib.sha256(flat.encode()).hexdigest()
    return out, books, df


def test_codes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 12).astype("f4").astype("f8").tolist(), int(i) % 4 if i % 5 else None) for i in range(400)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(150)]  # a hot group of copies
    rows += [(7, rows[8][1], 2), (7, rows[8][1], 2), (None, rows[9][1], 1), (2000, None, 1), (2001, [None] * 12, 1), (2002, [float("nan")] * 12, 1), (2003, [float("inf")], 1)]
    rows += [(2004, [], 3), (2005, [1.0], 3), (2006, [0.1] * 5, None)]  # shorter ones end in zeros
    out, books, _ = check_codes(spark, rows, parts=4, entries=16, rounds=2)
    ids = {r.vec_id: r.x for r in vector_codes.decoded(out.where("vec_id = 3"), books).collect()}
    x = [math.floor(256 * v) for v in rows[3][1]]
    assert sum((a - b) ** 2 for a, b in zip(x, ids[3], strict=True)) == out.where("vec_id = 3").first().error


def test_codes_few_rows_and_large_values(spark):
    check_codes(spark, [(1, [0.5, -0.5, 1.0, 2.0], 1), (2, [0.5, -0.5, 1.0, 2.0], 1), (3, [1e307, -1e307, 2.0**40, 0.0], None)], parts=2, entries=8, rounds=2)


def test_no_codes(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    out, _ = vector_codes.compress(df)
    assert out.columns == ["vec_id", "code", "error", "label_error"]
    assert out.count() == 0
    assert vector_codes.compress(df.limit(0))[0].count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 40), st.integers(1, 300), st.integers(1, 6))
def test_balls_give_the_nearest(seed, entries, n, spread):
    """Coarse grids are full of ties; the entries that rows come from may be any."""
    rng = np.random.default_rng(seed)
    x, books = rng.integers(-spread, spread + 1, (n, 3)), rng.integers(-spread, spread + 1, (entries, 3))
    code, best = vector_codes.nearest(x, books)
    for old in (code, rng.integers(0, entries, n)):
        new, d = vector_codes.nearest_by_balls(x, books, old)
        assert (new == code).all()
        assert (d == best).all()


def true_neighbours(rows, k, every):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            score = []
            for i, w in good:
                if i != q:
                    s = 0.0
                    for a, b in zip(v, w, strict=False):
                        s += a * b
                    score.append((-s, i))
            out[q] = [(i, -s) for s, i in sorted(score)[:k]]
    return out


def found(df, **options):
    out = defaultdict(list)
    for r in sorted(neighbours.neighbours(df, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("kind", ["unit", "lengths", "clusters"])
def test_neighbours_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 700)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    if kind == "clusters":
        x = x[rng.integers(0, 40, 3000)] + 0.2 * x
    if kind != "lengths":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:2000] = x[0] + 0.01 * x[1000:2000]  # a third of all rows are near copies
    rows = [(int(i), v.astype("f4").astype("f8").tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [None] * 24), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, block int")
    got, want = found(df, k=10, every=20), true_neighbours(rows, 10, 20)
    assert got.keys() == want.keys()
    assert all(len(own) == 10 for own in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in own}) for q, own in want.items()) >= 0.9 * 10 * len(want)
    by_id = dict(rows[:3000])
    for q, own in got.items():
        assert own == sorted(own, key=lambda p: (-p[1], p[0]))
        for i, score in own:
            assert score == sum(a * b for a, b in zip(by_id[q], by_id[i], strict=True)) or math.isclose(score, np.dot(by_id[q], by_id[i]), rel_tol=1e-12, abs_tol=1e-12)


def test_neighbours_ties_repeats_and_few(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [-1.0]), (3, [0.5, 0.5]), (2, [0.5, 0.5]), (5, [1e308, 1e308]), (6, [-3.0, 1e-3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(df, k=20, every=20)
    want = true_neighbours(rows, 20, 20)
    assert {q: [i for i, _ in own] for q, own in got.items()} == {q: [i for i, _ in own] for q, own in want.items()}
    same = [(i, [0.25, 0.5, 0.75]) for i in range(300)]  # all rows alike
    got = found(spark.createDataFrame(same, "vec_id long, embedding array<double>"), k=5, every=100)
    assert {q: [i for i, _ in own] for q, own in got.items()} == {q: [i for i in range(7) if i != q][:5] for q in (0, 100, 200)}
    assert found(df.where("vec_id < 0")) == {}
    assert found(df.where("vec_id % 20 <> 0")) == {}


def test_probing_finds_all_codes_within_a_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, (2000, 2), dtype=np.uint64)
    codes[500:900] = codes[3] ^ (np.uint64(1) << rng.integers(0, 63, (400, 2), dtype=np.uint64))
    block = neighbours.CodeBlock(np.arange(2000), np.zeros((2000, 1)), codes, neighbours.CodeBlock.orders_of(codes))
    for radius in (0, 1, 3, 7, 8, 20, 50, 64, 128):
        for q in (codes[3], codes[0], codes[600], rng.integers(0, 1 << 63, 2, dtype=np.uint64)):
            far = np.bitwise_count(codes ^ q).sum(axis=1)
            rows, own = block.within(q, radius)
            assert rows.tolist() == np.flatnonzero(far <= radius).tolist()
            assert own.tolist() == far[rows].tolist()
