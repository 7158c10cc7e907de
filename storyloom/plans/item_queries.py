"""Queries of vectors and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import models, similarity
from storyloom.session import table
from storyloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
THRESHOLD = 0.4  # no pair of the synthetic vectors reaches the production threshold


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def nn_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other vector of every vector whose id is divisible by 50."""
    rows = _vectors(spark, sf_dir)
    return similarity.nearest(rows.where("id % 50 = 0"), rows).withColumn("similarity", F.round("similarity", 6))


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.similar_pairs(_vectors(spark, sf_dir), THRESHOLD, exact=True)
    return found.withColumn("similarity", F.round("similarity", 6))


def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", models.embed(F.coalesce("text", F.lit(""))).alias("vector"))
    return docs.select("doc_id", F.size("vector").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ingest.stream_table(spark, sf_dir, "events").select("user_id", "event_type")
    return ingest.run_once(ingest.deduplicated(events, ["user_id", "event_type"]))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.run_once(ingest.counts(ingest.stream_table(spark, sf_dir, "events"), "event_type"), "complete")


QUERIES: dict[str, Query] = {
    "nn_top1": nn_top1, "similar_pairs": similar_pairs, "embed_texts": embed_texts, "stream_dedup": stream_dedup, "stream_counts": stream_counts,
}
_SIM = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
ORACLES: dict[str, str] = {
    "nn_top1": f"""SELECT id, nearest_id, round(s, 6) AS similarity FROM (
  SELECT a.vec_id AS id, b.vec_id AS nearest_id, {_SIM} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, b.vec_id) AS k
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE k = 1""",
    "similar_pairs": f"""SELECT a.vec_id AS a, b.vec_id AS b, round({_SIM}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE {_SIM} >= {THRESHOLD}""",
    "embed_texts": "SELECT doc_id, 64 AS n, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
}
