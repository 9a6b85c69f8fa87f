"""Piecewise encoding equals encoding whole texts; token files give back what was written; packing against simple bounds."""

import random
import zlib
from collections import Counter
from unittest import mock

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sensorloom.llm import packing, token_binary, tokens
from sensorloom.llm.tokens import Encoder

PARTS = ["\n\n", "\n\n\n", ".", ",", "İ", "İ.", "word.", "Word,", "A1)", "\r\n", "\x0b", "~", "a~b", "и.", "ñ;", "'", "\"", "..", "=\u0338", "the", "The", "  ", " ", "\n", "\t", "\n\n ", "a", "é", "ß", "日本", "'s", "'ll", "123", "4", "%%%", "!!", "<|endoftext|>", "\x1c", "\x85", " ", "　", "é", "́", "Σ", "İ", "👍🏽", "-", "_", "\x00", "​", "don't", "x" * 70, "﻿", "\xa0"]


@pytest.mark.parametrize(("name", "white"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_equal_whole(name, white):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(5)
    texts = ["", " ", "\n", *("".join(rng.choices(PARTS, k=rng.randint(1, 14))) for _ in range(4000))]
    own = Encoder(path, white)
    for text, got in zip(texts, own.encode(pa.array(texts)), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize(("name", "white"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_equal_whole_on_documents(name, white):
    """Real texts, some of them twice, with a table so small that pieces leave it."""
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    own = Encoder(public_tokenizers.path(name), white)
    with mock.patch.object(tokens, "KEPT_PIECES", 20_000):
        got = [ids for at in (*range(0, len(texts), 100), 0) for ids in own.encode(pa.array(texts[at : at + 100]))]
    for text, ids in zip([*texts, *texts[:100]], got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.04, rng.integers(0, 2**32 - 1, n), rng.integers(0, 50_000, n)).astype("<u4")
    blocks = token_binary.encode_blocks(ids) if n else []
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.int64)
    back = token_binary.decode_blocks(b"".join(blocks), starts) if n else np.empty(0)
    assert back[:n].tolist() == ids.tolist()


def test_files_round_trip(spark, tmp_path):
    rows = [(3, "c d"), (1, None), (2, ""), (2, "twice"), (2, "twice"), (2, "three times"), (None, "no id"), (None, None), (9, "word " * 300_000)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, start string")
    out = token_binary.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mix = {r.t: r.h for r in docs.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS h").collect()}
    start, want = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, mix[r[1] or ""])):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want
    assert token_binary.round_trip(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_valid_and_tight(seed):
    rng = np.random.default_rng(seed)
    size = 2048
    lengths = np.minimum(size, rng.lognormal(5 + seed / 3, 1, 4000).astype(int) + 1)
    bins, offsets, n = packing.best_two_fit(lengths, size)
    for b in range(n):
        own = np.argsort(offsets[bins == b])
        sizes = lengths[bins == b][own]
        assert offsets[bins == b][own].tolist() == (np.cumsum(sizes) - sizes).tolist()
        assert sizes.sum() <= size
    assert set(bins.tolist()) == set(range(n))
    firsts: list[int] = []  # first fit, largest first
    for x in sorted(lengths.tolist(), reverse=True):
        k = next((i for i, free in enumerate(firsts) if free >= x), None)
        if k is None:
            firsts.append(size - x)
        else:
            firsts[k] -= x
    assert n <= len(firsts)
    assert packing.best_two_fit(np.array([], np.int64), size)[2] == 0


def test_pack_rows(spark):
    rows = [(1, "a b c"), (1, None), (None, ""), (4, "word " * 5000), (5, "x" * 3000)]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, piece int, shard int")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r[:5]) for r in out), key=str) == sorted(want, key=str)
    for s in {r.sequence_id for r in out}:
        own = sorted((r.offset, r.length) for r in out if r.sequence_id == s)
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()
    assert packing.pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_equal_rows_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 100)
    docs = spark.range(1000).selectExpr("cast(NULL AS long) AS doc_id", "cast(NULL AS string) AS text")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    shards = Counter(r.sequence_id >> 32 for r in out)
    assert len(out) == 1000 and len(shards) == 10 and max(shards.values()) < 200
