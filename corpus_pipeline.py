"""A corpus pipeline of five stages, each of which works on all that the one before kept.

Language ID drops documents whose language is not identified; the Jaccard join keeps one document
of each group of near copies (five-word shingles, similarity 0.8 or more); decontamination drops
documents that hold a benchmark item; the secret scan masks secrets in the texts; packing lays the
rest out in sequences. All but the last return the columns of documents.

Stages take what their operators take: null texts have no language and go; other columns pass as
they are, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import materialise, table
from gridmill.llm.decontaminate import contaminated
from gridmill.llm.jaccard_join import keep_one
from gridmill.llm.language_id import keep_identified
from gridmill.llm.packing import pack_documents
from gridmill.llm.secret_scan import redact


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a posterior of at least a half."""
    return keep_identified(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id."""
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; those without doc_id cannot be named and stay."""
    found = materialise(contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__found")).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].cast("long") == found["__found"], "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked."""
    return redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, with their places in sequences."""
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]
# Trained scores, randomised search and token ids are not SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
