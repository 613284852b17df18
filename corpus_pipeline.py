"""A training corpus from documents: stages of the operators in millrace.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what
it returns is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, exact_dedup, jaccard_join, sentence_pieces, toxicity
from millrace.llm._tables import read, written
from millrace.llm.queries import PIECE_MODEL, tokenizer_bytes


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest identifier."""
    return exact_dedup.drop_exact(docs, keep="max")


def keep_dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.drop_similar(docs, width=5, percent=80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words occurs."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of pieces and digests of the pieces and of the decoded text of each document."""
    return sentence_pieces.encode_documents(docs, tokenizer_bytes(PIECE_MODEL))


STAGES = [
    ("toxicity", keep_clean),
    ("exact_dedup", keep_distinct),
    ("jaccard_join", keep_dissimilar),
    ("decontaminate", keep_uncontaminated),
    ("sentence_pieces", encode),
]

#: No stage but the second and fourth can be said in SQL; the pipeline is tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
