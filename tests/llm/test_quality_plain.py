"""The quality query against a plain version: sampled rows, windows, dictionaries, sizes and the fit, without Spark."""

import shutil

import numpy as np
import pandas as pd
import pytest
import xxhash
import zstandard

import __spark_entry__
from sensorloom.llm import quality
from sensorloom.llm.labelled import Logistic

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def mixed(*values):
    """Spark's xxhash64 of texts: each one's hash seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode(), seed=seed)
    return signed(seed)


def crc(doc):
    import zlib

    return zlib.crc32(str(doc).encode())


def sizes(text, dictionaries):
    out = [0, 0, 0]
    for at in range(0, len(text), quality.WINDOW_CHARS):
        data = text[at : at + quality.WINDOW_CHARS].encode()
        out[0] += len(data)
        for k, d in enumerate(dictionaries):
            made = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            out[k + 1] += len(made.compress(data))
    return out


@pytest.fixture(scope="module")
def tables():
    docs = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    return docs, labels


def test_query_against_plain_version(spark, tables, tmp_path):
    docs, labels = tables
    docs = docs.copy()
    docs.loc[3, "text"] = None
    docs.loc[4, "text"] = ""
    shutil.copy(f"{SF}/labels.parquet", tmp_path / "labels.parquet")
    docs.to_parquet(tmp_path / "documents.parquet")
    known = {int(r.doc_id): int(r.quality) for r in labels.itertuples() if r.quality in (0, 1) and crc(int(r.doc_id)) % 5 != 0}
    texts = {int(r.doc_id): r.text or "" for r in docs.itertuples()}
    rows = [(i, texts[i], q, mixed(str(i), "fold") % 4) for i, q in known.items() if i in texts]
    dictionaries = []
    for label in (0, 1):
        windows = [t[a : a + quality.SAMPLE_CHARS] for _, t, q, fold in rows if q == label and fold for a in range(0, max(len(t), 1), quality.SAMPLE_CHARS)]
        windows = sorted((w for w in windows if len(w) >= 8), key=lambda w: (mixed(w, "window"), w.encode()))
        dictionaries.append(quality.dictionary([w.encode() for w in windows[: quality.MAX_WINDOWS]]))
    held = [(sizes(t, dictionaries), q) for _, t, q, fold in rows if fold == 0]
    fit = Logistic(quality.features(np.array([s for s, _ in held], float).reshape(-1, 3)), np.array([q for _, q in held], float))
    want = {i: float(fit(quality.features(np.array([sizes(t, dictionaries)], float)))[0]) for i, t in texts.items()}
    got = __spark_entry__.queries()["op4_quality"](spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6), r.doc_id
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (crc(r.doc_id) % 5 == 0)
