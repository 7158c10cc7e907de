"""Query of the token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import wordpiece
from storyloom.llm.common import table


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, greedy tokens and unknown words."""
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES: dict[str, str] = {}
