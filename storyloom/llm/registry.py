"""The training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import decontaminate_queries, language_queries, negatives_queries, ngram_queries, pieces_queries, quality_net_queries, quality_queries, quotes_queries, secrets_queries, simhash_queries, vector_codes_queries, warc_queries, wordpiece_queries

_MODULES = (simhash_queries, quality_queries, decontaminate_queries, secrets_queries, wordpiece_queries, pieces_queries, quality_net_queries, language_queries, ngram_queries, quotes_queries, negatives_queries, vector_codes_queries, warc_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
