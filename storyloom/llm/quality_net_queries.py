"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import quality_net
from storyloom.llm.common import table


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the probability of good quality."""
    return quality_net.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
