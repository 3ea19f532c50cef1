"""The training-data pipeline: documents in, token digests of what is worth training on out.

Stages, each a function of (spark, docs, sf_dir): quality classifier, line dedup, SimHash near-dedup completed to all pairs
of a Jaccard similarity, benchmark decontamination and BPE. All but the last return the columns of documents. Every stage
reads whole texts, however long, and gives an empty table for an empty one; names that begin with two underscores are the
operators'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, decontam, line_dedup, near_copies, quality
from foliant.llm.common import small_batches, table
from foliant.llm.queries import load, vocabulary


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null text scores as an empty one; alike texts, and so repeated rows, go
    or stay together; without labels of both kinds all stay."""
    small_batches(spark)
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; n_chars follows the text. Copies, which the next stage drops, are one page. A null
    text stays null, a null source is a source, and a text whose lines all go is empty."""
    small_batches(spark)
    out = line_dedup.drop_lines(docs, copies_once=True)
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id (a null one last): five-word
    shingles, Jaccard similarity 0.8 or more. Texts without words, null ones among them, are one group; repeated rows are
    copies."""
    small_batches(spark)
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go, by id and text, so clean rows of the same id, or without one, stay. Null
    texts overlap nothing."""
    small_batches(spark)
    return decontam.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text that they decode to, a row for each row. A null text is empty."""
    small_batches(spark)
    return bpe.encode_digests(docs, vocabulary())


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("bpe", tokenize),
]

#: SQL can't express the classifier, near copies and BPE; tests/llm/test_pipeline_model.py compares run() with a plain-Python
#: model of the five stages on planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's result is written to the shared folder before the next reads it, so none
    is computed twice."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
