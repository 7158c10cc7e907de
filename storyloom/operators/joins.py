"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that more than one row in ``HEAVY`` has, ``HEAVY`` at most, are joined by broadcast.
HEAVY = 1000


def join_counted(rows: DataFrame, counted: DataFrame, key: str | list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``counted`` (key, n, ...), whose ``n`` is how many of the ``total`` rows have a key; without ``n``.

    The frequent keys are few by their counts, so they are broadcast and their rows stay where they are. The others
    are joined by a shuffle in which no key is hot. ``how`` is inner or left_semi; null keys match nothing.
    """
    heavy, light = (counted.where(c) for c in (F.col("n") * HEAVY > total, F.col("n") * HEAVY <= total))
    keys = [key] if isinstance(key, str) else key
    there = rows.join(F.broadcast(heavy), keys, how)
    return there.unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)).drop(*["n"] * (how == "inner"))
