"""The pipeline's stages, one after the other, against brute force on a small table with planted rows."""

import os
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from sensorloom.llm import common, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.where("length(text) > 1500").orderBy("doc_id").limit(1)
    extra = [
        one.withColumn("doc_id", F.lit(900_001)),
        one.withColumn("doc_id", F.lit(900_002)).withColumn("text", F.concat("text", F.lit(" tail"))),
        one.withColumn("doc_id", F.lit(900_003)).withColumn("text", F.lit(None).cast("string")),
        one.withColumn("doc_id", F.lit(900_004)).withColumn("text", F.lit("")),
        one.withColumn("doc_id", F.lit(900_005)).withColumn("source", F.lit(None).cast("string")).withColumn("text", F.lit("entirely new words of a clean document")),
    ]
    for e in extra:
        docs = docs.unionByName(e.withColumn("doc_id", F.col("doc_id").cast("long")))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return str(d)


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_stages(spark, planted, tmp_path):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_join", "mixing", "packing"]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES:
        out = stage(spark, docs, planted)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        if name == "toxicity":
            toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{planted}/labels.parquet").collect()}
            kept = {r.doc_id for r in rows}
            assert sum(1 for d, t in toxic.items() if not t and d in before and d not in kept) <= 0.02 * len(toxic)
            assert {900_003, 900_004, 900_005} <= kept  # null, empty and clean texts stay
            same = {d for d, r in before.items() if r.text == before[900_001].text}
            assert 900_001 in same and len(same) > 1 and len(same & kept) in (0, len(same))  # equal texts share their fate
        elif name == "exact_dedup":
            first: dict[str, int] = {}
            for r in before.values():
                first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
            assert {r.doc_id for r in rows} == set(first.values()) and len(rows) == len(first)
        elif name == "ngram_join":
            sets = {d: shingles(r.text) for d, r in before.items()}
            root = {d: d for d in before}

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            ids = sorted(before)
            for i, a in enumerate(ids):
                for b in ids[:i]:
                    if sets[a] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
            assert {r.doc_id for r in rows} == {find(d) for d in before}
            assert 900_002 not in {r.doc_id for r in rows}
        elif name == "mixing":
            times = Counter(r.doc_id for r in rows)
            assert set(times) == set(before) and max(times.values()) <= 2
        else:
            plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            plain.encode_special_tokens = True
            want = Counter()
            for d, n in times.items():
                want[d] = n * (len(plain.encode(before[d].text or "", add_special_tokens=False).ids) + 1)
            got = Counter()
            for r in rows:
                got[r.doc_id] += r.length
            assert got == want
            used = Counter()
            for r in rows:
                used[r.sequence_id] += r.length
            assert max(used.values()) <= 2048
            assert len(used) <= 1.03 * sum(used.values()) / 2048 + 1
        if name != "packing":
            before = {r.doc_id: r for r in rows}


def test_run_and_empty(spark, planted, tmp_path):
    top = common.as_uri(common.shared_dir(spark)).removeprefix("file://")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    out = P.run(spark, planted)
    assert out.count() > 0
    assert sorted(name.rsplit("-", 1)[0] for name in set(os.listdir(top)) - before) == ["pieces", "pipeline-mixing"]
    spark.read.parquet(f"{planted}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{planted}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op3_warc", "op8_top_k_search", "op12_vector_codes", "op13_near_neighbours"}))
def test_queries_on_empty_documents(spark, planted, tmp_path, name):
    spark.read.parquet(f"{planted}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{planted}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
