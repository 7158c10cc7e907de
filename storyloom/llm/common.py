"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.graph import cut, shared_folder  # noqa: F401
from storyloom.operators.joins import join_counted  # noqa: F401

#: ASCII white space that separates words: space, tab, LF, VT, FF, CR.
WORD_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the columns an operator works on, under its own names: (doc_id, text)."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def without(df: DataFrame, id_col: str, ids: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of ``df`` whose id is not among ``ids`` (one column ``id``); how="left_semi" for those whose is."""
    left, right = df.alias("_rows"), ids.alias("_ids")
    return left.join(right, F.col(f"_rows.`{id_col}`") == F.col("_ids.id"), how)


def per_batch(
    run: Callable[[pa.RecordBatch], pa.RecordBatch | None],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that handles a batch."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := run(batch)) is not None and out.num_rows:
                yield out

    return apply
