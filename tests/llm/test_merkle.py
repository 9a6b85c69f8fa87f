"""Merkle manifests against plain trees."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sensorloom.llm import common, merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def steps(tree, at):
    """(before, after) of a node's run on each level below the root."""
    out = []
    for nodes in tree[:-1]:
        run = at // 3 * 3
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
        at //= 3
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, source, lang, n_chars, text), tampered with as the query does."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            path = steps(trees[s], i) + steps(top, k)
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf((*r[:4], text))
            for before, after in path:
                node = sha(before, node, after)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha(*(b + a for b, a in path)), node))
    return out


def table(spark, rows, tmp_path):
    """The rows as the query's table, behind columns whose names the operator uses itself."""
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumns({c: F.lit(1) for c in ("tree", "node", "rank", "block", "nest", "item", "part", "over", "path", "nth", "id")})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_query_against_plain_tree(spark, tmp_path):
    rows = []
    for k, n in enumerate([1, 2, 3, 4, 9, 10, 28, 82, 800]):
        rows += [(1000 * k + i, f"s{k}é" if k else None, "en", i, f"line {i}\nmore\n" if i % 3 else "one line") for i in range(n)]
    rows += [(5, "s1é", None, None, None), (None, "s3é", "de", 1, "a\nb"), (None, "s3é", "de", 1, "a\nb"), (7, "", "", 0, ""), (8, None, None, None, "long " * 200_000 + "\n")]
    rows += [(3001, "s3é", "en", 1, "twice\n"), (3001, "s3é", "en", 1, "other\n")] + [(9, "S", "x", 1, "same\n")] * 40
    got = __spark_entry__.queries()["op11_merkle_manifest"](spark, table(spark, rows, tmp_path)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got), key=key) == sorted(plain(rows), key=key)
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 3, 730, 2188])
def test_one_source_of_all_rows(spark, n):
    """A hot source is ranked over several partitions and nested in several blocks."""
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("t"), "id").alias("text"))
    out = merkle.manifest(docs, ["doc_id", "text"])
    tree = levels([leaf((i, f"t{i}")) for i in range(n)])
    got = out.select("doc_id", "leaf", "root", "subroot", F.size("path").alias("steps"), merkle.folded(F.col("leaf"), F.col("path")).alias("up")).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    assert {(r.root, r.subroot, r.up) for r in got} == {(tree[-1][0],) * 3}
    assert {r.leaf for r in got} == set(tree[0])


def test_each_row_its_own_source(spark):
    rows = [(i, f"s{i}", "en", 1, "t") for i in range(2200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(docs, FIELDS).select("doc_id", "subroot", "root").collect()
    want = {r[0]: r[2:4] for r in plain(rows)}
    assert {r.doc_id: (r.subroot, r.root) for r in got} == want


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert merkle.manifest(docs, ["doc_id", "text"]).collect() == []


def test_files_follow_the_rows(spark, tmp_path, monkeypatch):
    """Many partitions of few rows are stored in few files (on check_h they took 383, leaves included), and ranks go on over them."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = [(i, f"s{i % 40}" if i % 3 else "hot", "en", 1, f"t{i}") for i in range(3000)]
        docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
        got = merkle.manifest(docs, FIELDS).select("doc_id", "leaf", "subroot", "root", merkle.folded(F.col("leaf"), F.col("path")).alias("up"))
        assert got.rdd.getNumPartitions() == 1
        got = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got == {r[0]: (*r[1:4], r[3]) for r in plain(rows)}
    files = [p.parent.name for p in (tmp_path / "shared").glob("merkle-*/part-*.parquet")]
    assert len([f for f in files if not f.startswith("merkle-leaves")]) < 8, files
