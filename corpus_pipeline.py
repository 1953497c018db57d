"""A corpus pipeline: each stage is one operator of ``factorloom.llm``, written as Parquet and reread by the next.

Language ID rejects texts whose language cannot be told, exact dedup and near-dedup keep one row of each group, mixing takes
each row as often as its source's target asks for, and BPE turns the mixture into token ids.

Cases, as each stage's operator states them in full
-----
* language ID drops null, empty and letterless texts, so no later stage meets them; null lang, source or doc_id drop nothing
* very long texts are read whole by every stage
* exact dedup: ties go to the larger doc_id, null below all; of repeated rows one stays
* near-dedup: of a class the least doc_id stays; rows without doc_id stay only where no member has one
* mixing: null is a source of its own; repeated rows share out what is taken of them
* an empty table stays empty through all stages; further columns, whatever their names, stay until BPE selects its own
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from factorloom.llm.common import stage, table
from factorloom.llm.queries import BYTE_BPE, PIECES


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (3): documents without a language that can be told go."""
    return language_id.keep_identified(docs, PIECES)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (8): of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (5): one document of each group stays, the one with the least doc_id."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (10): each document as often as weighted fair queueing takes it."""
    return mixing.mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE (2): token ids of each document of the mixture."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), BYTE_BPE)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", identified),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing", mixed),
    ("BPE", tokens),
]
#: SQL cannot express the learned, sketched and tokenised stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
