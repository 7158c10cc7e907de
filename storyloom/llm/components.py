"""Connected components by alternating large-star and small-star steps, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import cut, join_counted


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    Each step groups the neighbours of a node by their minimum (a partial aggregate) and joins it back, nodes with
    many neighbours by broadcast, so no neighbourhood is ever held in one place. The lineage is cut by a checkpoint after each round. Null ends
    and loops are ignored; repeated edges count once.
    """
    pairs = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    while True:
        stars = cut(_small_star(cut(_large_star(pairs))))
        # A forest of stars is stable: no root has a root of its own, and no node has two.
        again = stars.join(stars.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        twice = 0 if again else stars.groupBy("u").count().where("count > 1").limit(1).count()
        pairs = stars
        if not again and not twice:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _with_least(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``m``, the smallest neighbour of ``u``."""
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    return join_counted(pairs, least, "u", least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = _with_least(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    return both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is tied to the smallest of them."""
    joined = _with_least(pairs)
    others = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return others.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
