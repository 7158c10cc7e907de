"""Iterative graph steps on Spark; each round cuts its lineage by a checkpoint in the shared folder."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rounds whose results are put together at once.
FANIN = 16


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where a local session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="storyloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def first_independent_set(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) of the independent set that goes by order: a node is in it if no earlier neighbour is.

    ``nodes`` has node, ``edges`` has a < b. This is what a loop over the nodes in order would give. In each
    round all nodes without an undecided earlier neighbour are decided at once; their neighbours fall out.
    """
    open_nodes, open_edges = cut(nodes.select("node").distinct()), cut(edges.select("a", "b").where("a < b").distinct())
    levels: list[list[DataFrame]] = [[]]
    while open_nodes.limit(1).count():
        first = cut(open_nodes.join(open_edges.select(F.col("b").alias("node")).distinct(), "node", "left_anti"))
        _add(levels, first)
        out = open_edges.join(first.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        open_nodes = cut(open_nodes.join(first, "node", "left_anti").join(out, "node", "left_anti"))
        kept = open_nodes.select(F.col("node").alias("a"))
        open_edges = cut(open_edges.join(kept, "a", "left_semi").join(kept.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"))
    rounds = [x for level in levels for x in level]
    return _all(rounds) if rounds else nodes.select("node").limit(0)


def _add(levels: list[list[DataFrame]], rows: DataFrame) -> None:
    """Keep a round's rows; sixteen of one level become one of the next, so a row is written again a few times only."""
    levels[0].append(rows)
    k = 0
    while len(levels[k]) == FANIN:
        if k + 1 == len(levels):
            levels.append([])
        levels[k + 1].append(cut(_all(levels[k])))
        levels[k], k = [], k + 1


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
