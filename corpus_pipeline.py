"""The corpus pipeline: documents to packed pieces, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last
return the columns of ``documents``.  :func:`run` writes each stage's result as
Parquet to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import materialize, table
from tidemark.llm.exact_dedup import keep_one
from tidemark.llm.ngram_join import keep_class_heads
from tidemark.llm.packing import default_tokenizer, pack
from tidemark.llm.secrets import redact
from tidemark.llm.toxicity import drop_toxic

#: Workers have run four stages before they pack, so they remember less (bytes) than in a run of their own, and nothing beyond a task; the pieces are the same.
REMEMBERED = 40_000_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that score 0.5 or more go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts the longest original, then the smallest doc_id, stays."""
    return keep_one(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the smallest doc_id of each class of near duplicates stays."""
    return keep_class_heads(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every secret is replaced by its kind in brackets."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the pieces of all documents, by sequence and offset."""
    return pack(docs, default_tokenizer(), remembered=REMEMBERED, keep=False)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: Classifier, MinHash join and tokenizer are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
