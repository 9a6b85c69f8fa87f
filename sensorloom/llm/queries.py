"""The registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, line_dedup, merkle, mixing, neighbours, ngram_join, packing, quality, token_binary, topk, toxicity, vector_codes, warc
from .common import crc32_mod, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents. Null and empty texts share one score, a null id isn't held out, repeated rows are scored alike; no documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda doc_id: crc32_mod(doc_id, 3) != 1)
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents without later repeats. Null texts are one empty line, rows of one id one document; no documents give no rows."""
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, i, string_split(t, chr(10))[i] AS line FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d,
  LATERAL (SELECT unnest(generate_series(1, len(string_split(d.t, chr(10))))) AS i) g),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first_doc < doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE first_doc IS NULL OR first_doc = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN m USING (key) GROUP BY doc_id
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back. Null payloads are empty, null urls left out; no pages give no rows."""
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload")


OP3_SQL = """
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < best THEN best END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents. Null and empty texts share one score, a null id isn't held out, repeated rows are scored alike; no documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), lambda doc_id: crc32_mod(doc_id, 5) != 0)
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, null as empty; the largest id stays, a null id only alone; no documents give no rows."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies; they are installed with the library, not copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens. Null and empty texts are the end id alone, repeated rows are packed each; no documents give no rows."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), white_space_counts=False, size=2048)


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens written to files and read back. Null ids come first, null and empty texts are the end id alone; no documents give no rows."""
    return token_binary.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector among all. See topk.top_k for nulls, lengths, ties and repeated ids."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM s QUALIFY rank <= 5
"""

def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, groups and numbers of near copies of all documents. Texts without words link to nothing; null and repeated ids are rows like others; no documents give no rows."""
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), threshold=0.8, width=5, target_recall=0.9999).drop("text_hash", "group_hash")


#: Brute force; Python's word characters are letters, numbers and the underscore.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
r AS (SELECT doc_id, doc_id AS g FROM s UNION SELECT c.b, r.g FROM r JOIN c ON r.doc_id = c.a),
k AS (SELECT doc_id, min(g) AS group_id FROM r GROUP BY 1),
m AS (SELECT a AS doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT doc_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id, group_id, coalesce(n, 0) AS n_links, len(s) AS n_shingles
FROM s JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents in a mixture of their sources. Null sources are one source, null texts have no tokens; no documents give no rows."""
    return mixing.mix(table(spark, sf_dir, "documents"), target_entropy=0.97, max_repeats=4.0).drop("text_hash")

def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves of a Merkle tree, with proofs; every second one is held against a text without newlines. See merkle.manifest for nulls, ties and repeats; a null id isn't tampered with; no documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    text = F.col("text").cast("string")
    tampered = F.when(crc32_mod(F.col("doc_id"), 2) == 0, F.translate(text, "\n", "")).otherwise(text)
    held = {"tampered_leaf": merkle.digest([*(merkle.field(F.col(c)) for c in fields[:-1]), merkle.field(tampered)])}
    rows = merkle.manifest(docs, fields, carry=held)
    rows = rows.withColumn("folded_root", merkle.folded(F.col("tampered_leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels as lists: those of each source, then those over the sources. crc32 by shifting bits (-1 in the list of steps).
OP11_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN (list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END) & 1) = 1 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
f AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM d),
l AS (SELECT doc_id, coalesce('s:' || source, 'none') AS src, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS other FROM f),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
t AS (SELECT src, 0 AS lev, list(leaf ORDER BY pos) AS hs FROM r GROUP BY src UNION ALL
  SELECT src, lev + 1, list_transform(range((len(hs) + 2) // 3), lambda i: sha256(array_to_string(hs[3 * i + 1 : 3 * i + 3], ''))) FROM t WHERE len(hs) > 1),
s AS (SELECT src, lev AS height, hs[1] AS subroot, row_number() OVER (ORDER BY src) - 1 AS spos FROM t WHERE len(hs) = 1),
g AS (SELECT 0 AS lev, list(subroot ORDER BY spos) AS hs FROM s UNION ALL
  SELECT lev + 1, list_transform(range((len(hs) + 2) // 3), lambda i: sha256(array_to_string(hs[3 * i + 1 : 3 * i + 3], ''))) FROM g WHERE len(hs) > 1),
a AS MATERIALIZED (SELECT src, lev, hs FROM t WHERE len(hs) > 1 UNION ALL SELECT src, height + lev, g.hs FROM s, g WHERE len(g.hs) > 1),
w AS (SELECT r.doc_id, r.leaf, s.src, 0 AS lev, r.pos, s.spos, s.height, r.other AS node, '' AS proof FROM r JOIN s USING (src) UNION ALL
  SELECT w.doc_id, w.leaf, w.src, w.lev + 1, p // 3, w.spos, w.height, sha256(array_to_string(hs[p - p % 3 + 1 : p], '') || node || array_to_string(hs[p + 2 : p - p % 3 + 3], '')),
    proof || array_to_string(hs[p - p % 3 + 1 : p], '') || array_to_string(hs[p + 2 : p - p % 3 + 3], '')
  FROM (SELECT w.*, a.hs, CASE WHEN w.lev = w.height THEN w.spos ELSE w.pos END AS p FROM w JOIN a ON w.src = a.src AND w.lev = a.lev) w)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM w JOIN s USING (src), (SELECT hs[1] AS root, lev AS over FROM g WHERE len(hs) = 1) WHERE w.lev = w.height + over
"""

def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as codes of 16 parts by codebooks of 64 entries. See vector_codes.compress for nulls, lengths, ties and repeats; no vectors give no rows."""
    out, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    return out.select("vec_id", vector_codes.code_text(F.col("code")).alias("code"), "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def _op12_sql() -> str:
    """Every part against every entry, three times."""
    near = """a{k} AS MATERIALIZED (SELECT vec_id, label, part, x, entry, d FROM (SELECT p.*, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM p JOIN c{k} c ON p.part = c.part) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)"""
    move = """c{n} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
  SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS x FROM (SELECT part, entry, j, sum(x[j]) AS s, count(*) AS n FROM a{k}, range(1, len(x) + 1) r(j) GROUP BY ALL) GROUP BY ALL) m ON c.part = m.part AND c.entry = m.entry)"""
    steps = [near.format(k=0), move.format(k=0, n=1), near.format(k=1), move.format(k=1, n=2), near.format(k=2)]
    return """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS x FROM v, range(16) r(part)),
c0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
""" + ",\n".join(steps) + """,
h AS (SELECT sha256(string_agg(CAST(x[j] AS VARCHAR), ',' ORDER BY part, entry, j)) AS h FROM c2, range(1, len(x) + 1) r(j)),
e AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM e, h
"""

def op13_near_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth embedding among all. See neighbours.neighbours for nulls, lengths, ties and repeats; no vectors give no rows. Approximate by its method: no SQL, tests hold it against brute force."""
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20, recall=0.95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_line_dedup, op3_warc, op4_quality, op5_exact_dedup, op6_best_fit_packing, op7_token_binary, op8_top_k_search, op9_ngram_join, op10_mixing, op11_merkle_manifest, op12_vector_codes, op13_near_neighbours)
}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op8_top_k_search": OP8_SQL, "op9_ngram_join": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op12_vector_codes": _op12_sql()}
