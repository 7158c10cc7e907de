"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import secrets
from storyloom.llm.common import table


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base counts and all spans of secrets."""
    return secrets.scan(table(spark, sf_dir, "documents"))


QUERIES = {"op9_secrets": op9_secrets}
ORACLES: dict[str, str] = {}
