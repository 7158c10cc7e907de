"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import language
from storyloom.llm.common import table


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its most likely language."""
    return language.identify(table(spark, sf_dir, "pages"), language.fit(table(spark, sf_dir, "documents")))


QUERIES = {"op8_language": op8_language}
ORACLES: dict[str, str] = {}
