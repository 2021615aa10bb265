"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, folder of tables) and works on all that the one
before it kept; between stages the documents are written and read again. A row
without a doc_id passes through every stage that judges texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import dropped, table, written
from noteloom.llm.near_copies import one_of_each
from noteloom.llm.packing import pack_documents
from noteloom.llm.quality import ACCEPT, score_quality
from noteloom.llm.substring_dedup import remove_repeated_passages
from noteloom.llm.toxicity import THRESHOLD, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label model accepts. Null and empty texts score
    zero and go; rows are judged each by itself, repeated ids or not."""
    return score_quality(docs, COLUMNS[1:]).where(F.col("score") >= ACCEPT).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; null and empty texts
    have the score of a text without features."""
    return score_toxicity(docs, table(spark, sf_dir, "labels"), COLUMNS[1:]).where(F.col("score") < THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: five-word
    shingles, a similarity of 0.8 or more."""
    return one_of_each(docs, COLUMNS[1:])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat from smaller ones. A
    document that loses nothing keeps its text as it is."""
    cut = remove_repeated_passages(docs, carry=COLUMNS[1:])
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; a null or empty
    text is one piece, the end id."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
