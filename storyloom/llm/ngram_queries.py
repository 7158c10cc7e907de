"""Query of language-model scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import ngram_model
from storyloom.llm.common import table


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its unigram base score and the model's log10 probability."""
    return ngram_model.learn_and_score(table(spark, sf_dir, "documents"))


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
ORACLES: dict[str, str] = {}
