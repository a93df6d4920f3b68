"""Corpus pipeline: quality rules, near-duplicate removal, secret redaction, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the shared folder and reads it as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masswright.llm import jaccard, packing, quality, secrets
from masswright.llm.common import read_table, stage_table
from masswright.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the quality rules.

    Null and empty texts fail them.  Rows are judged one by one, so repeated rows and ids
    all stay or all go; null ids are kept as they are.  Columns beyond those of documents
    are dropped, and an empty table stays empty.
    """
    judged = quality.judge_quality(docs, read_table(spark, sf_dir, "labels"), keep=COLUMNS)
    return judged.where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: that with the smallest doc_id.

    Real ids come before null ones, and of rows with one id and text one is kept.  Null
    texts count as empty, texts of under five words are one shingle of them all, and texts
    without words are alike only if equal.  Columns beyond those of documents are dropped,
    and an empty table stays empty.
    """
    return jaccard.keep_one_each(docs).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by marks; all documents stay.

    Runs of overlapping spans get one mark, of the span that starts first, the longest of
    such.  A null text stays null; n_chars is counted again.  Repeated rows and null ids
    are kept as they are.  Columns beyond those of documents are dropped, and an empty
    table stays empty.
    """
    clean = secrets.redact_documents(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens, one row a piece.

    Null and empty texts are a single closing token.  Rows with null or equal ids are
    packed each on its own, pieces equal in all columns are interchangeable, and an empty
    table gives no rows.
    """
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the hashed n-grams nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
