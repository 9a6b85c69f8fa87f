"""A corpus pipeline of five stages: toxic documents go, exact copies go, near copies go, sources are mixed, sequences are packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns
of documents. Between stages the rows are written as Parquet and read again. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from sensorloom.llm.common import fresh_path, scratch, table
from sensorloom.llm.queries import vocabulary

#: No SQL: scoring, tokens and packing can't be expressed; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go. Learnt from at most toxicity.MAX_ROWS labelled rows.

    Null texts are scored as empty; rows of equal texts go or stay together.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda doc_id: F.lit(True))
    return toxicity.drop_toxic(docs, model, 0.7)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty), the smallest doc_id stays, and one of the rows that repeat it; a null id only alone."""
    return exact_dedup.drop_copies(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingle similarity of 0.8 or more, the smallest doc_id stays. Texts without words all stay."""
    return ngram_join.drop_near_copies(docs, threshold=0.8, width=5, target_recall=0.9999)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed by temperature: all documents stay, those of small sources come up to twice.

    Null sources are one source; null and empty texts have no tokens and come once.
    """
    return mixing.mixed(docs, target_entropy=None, max_repeats=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of 2048. Null and empty texts are the end id alone; repeated rows are packed each."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), white_space_counts=False, size=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage stored on its way goes once its result is stored. Mixed documents and their pieces stay."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as paths:
            path = fresh_path(spark, f"pipeline-{name}")
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
            paths.remove(path)
            paths += [before] if before else []
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
