"""The registered queries over the smallest tables: against their SQL, or against plain versions that take one document at a time."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sensorloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got, want = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(str(tuple(r[c] for c in names)) for r in got.collect())
    assert rows == sorted(str(r) for r in want.fetchall())


def ids_of(name, documents):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    return {d.doc_id: [*plain.encode(d.text or "", add_special_tokens=False).ids, 0] for d in documents}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_binary_query(spark, documents):
    want, start = [], 0
    for doc, ids in sorted(ids_of("byte_bpe_50k.json", documents).items()):
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op7_token_binary"](spark, SF).collect())) == want


def test_packing_query(spark, documents):
    out = QUERIES["op6_best_fit_packing"](spark, SF).collect()
    want = [(doc, k, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for doc, ids in ids_of("word_bpe_49k.json", documents).items() for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(tuple(r[:5]) for r in out) == sorted(want)
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(by_sequence) <= 1.02 * sum(n for *_, n, _ in want) / 2048 + 1


@pytest.mark.parametrize(("name", "modulus", "rest", "threshold"), [("op1_toxicity", 3, 1, 0.7), ("op4_quality", 5, 0, 0.3)])
def test_classifier_queries(spark, documents, name, modulus, rest, threshold):
    out = QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(d.doc_id for d in documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in out)
    text = {d.doc_id: d.text or "" for d in documents}
    by_text = {}
    for r in out:  # scores come from texts alone
        assert by_text.setdefault(text[r.doc_id], r.score) == r.score


def test_mixing_query(spark, documents):
    """All documents come, each as often as its source's passes say; weights follow one exponent."""
    out = QUERIES["op10_mixing"](spark, SF).collect()
    assert {r.doc_id for r in out} == {d.doc_id for d in documents}
    tokens, taken = Counter(), Counter()
    for d in documents:
        tokens[d.source] += len((d.text or "").split())
    for r in out:
        taken[r.source] += r.n_tokens
    shares = np.array([[tokens[s] / tokens.total(), taken[s] / taken.total()] for s in tokens if tokens[s]])
    slope = np.polyfit(np.log(shares[:, 0]), np.log(shares[:, 1]), 1)[0]
    assert 0 <= slope <= 1.02 and max(taken[s] / tokens[s] for s in tokens if tokens[s]) <= 4.1


def test_kept_lines_hash_is_of_the_kept_text(spark, documents):
    out = {r.doc_id: r for r in QUERIES["op2_line_dedup"](spark, SF).collect()}
    whole = [d for d in documents if out[d.doc_id].n_dropped == 0]
    assert whole and all(out[d.doc_id].kept_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest() for d in whole)
