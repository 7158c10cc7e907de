"""A corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, piece encoding.

Each stage is (name, function); the function takes (spark, docs, sf_dir), works on all that its predecessor
kept and returns the columns of ``documents``; the last returns the encoded documents. ``run`` writes every
stage's rows as Parquet below the shared folder and reads them again as the next stage's docs, so a lost
executor costs a part of a stage at most. Null texts are empty texts: the quality rules reject them. Empty tables
give empty tables; texts of any length go through whole; repeated rows (same id, same text) become one, and rows of
one id with texts that are no near-duplicates all stay, as do rows without an id; extra columns are carried up to
the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import decontaminate, pieces, quality_rules, secrets, simhash
from storyloom.llm.common import shared_folder, table

#: Jaccard similarity of five-word shingles from which the near-dedup stage takes two texts for one.
SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps."""
    return quality_rules.keep_passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Near-duplicates have fingerprints within four bits, or a five-word Jaccard similarity of 0.8 or more.
    """
    return simhash.keep_first(docs, similarity=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in clean.columns else clean


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, scores, others): every document as piece ids, with its further best paths and all scores."""
    return pieces.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "scores", "others")


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", redaction),
    ("piece_encoding", encoding),
]

#: SQL can't express fingerprints, redaction by structure or the piece lattice; the tests use plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
