"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyloom.plans import feed_queries, item_queries, source_queries, story_queries, stream_queries, text_queries

_MODULES = (feed_queries, text_queries, item_queries, source_queries, story_queries, stream_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
