"""Query of the WARC round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import warc
from storyloom.llm.common import table


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record in the archives tells of it."""
    found = warc.archive_roundtrip(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op13_warc": op13_warc}

ORACLES = {
    "op13_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages),
r AS (SELECT *, strlen(t) >= 100 AND f IS NOT NULL AND page_id IS DISTINCT FROM f AS again FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha256(t) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN f END AS refers_to
FROM r
"""
}
