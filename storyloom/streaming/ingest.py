"""Micro-batch ingestion: idempotent dedup, running counts, and logs with exactly-once batches.

A trigger of ``availableNow`` is a scheduled run: it takes what is new since its checkpoint and ends. The
checkpoint is the watermark, and it moves only after the sink has the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.graph import shared_folder
from storyloom.streaming.store import BatchStore


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A stream wants a folder or a pattern; this one matches the table alone.
    return reader.parquet(f"{sf_dir.rstrip('/')}/[{name[0]}]{name[1:]}.parquet")


def columns_of(df: DataFrame) -> str:
    """The DDL of a table's columns."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def run_batches(stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hand every new micro-batch to ``store`` and end."""
    stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run a stream over all that is there and read its result back.

    Append results go to Parquet; a complete result is written anew by each batch. A run that finds nothing new gives
    the result of the last one.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    checkpoint, out = checkpoint or f"{folder}/state", out or f"{folder}/rows"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out).outputMode(mode).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    results = BatchStore(spark, out, {"rows": columns_of(stream)})
    run_batches(stream, lambda batch, number: results.commit(number, {"rows": batch}), checkpoint, mode)
    last = results.batches()[-1:]
    return results.read("rows").where(F.col("batch") == last[0] if last else F.lit(True)).drop("batch")


def deduplicated(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each key once. With an event time the state of a key is dropped after ``delay``; without, it stays."""
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def counts(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def append_unseen(stream: DataFrame, key: str, log: str, checkpoint: str) -> DataFrame:
    """Append rows whose key the log at path ``log`` lacks; gives the log's rows with their ``batch``.

    A batch counts once its manifest, beside the log, is there: one that was lost while it wrote is written again in whole,
    and one that is run again after it was committed adds nothing, as the log has its keys. (Who reads the folders below
    ``log`` by themselves may see what a lost batch has left.) Null is a key like any other; of a batch's rows of one
    key the smallest stays. Batches get the log's own numbers, so a stream with a new checkpoint goes on where the log ends.
    """
    folder, _, name = log.rstrip("/").rpartition("/")
    rows = BatchStore(stream.sparkSession, folder, {name: columns_of(stream)}, manifest=f"{folder}/{name}.manifest")
    others = [c for c in stream.columns if c != key]

    def store(batch: DataFrame, number: int) -> None:
        there = rows.batches()
        one = batch.groupBy(key).agg(F.min(F.struct(*others)).alias("t")).select(key, "t.*") if others else batch.select(key).distinct()
        seen = rows.read(name).select(F.col(key).alias("_seen")).distinct()
        fresh = one.join(seen, F.col(key).eqNullSafe(F.col("_seen")), "left_anti")
        rows.commit(there[-1] + 1 if there else 0, {name: fresh})

    run_batches(stream, store, checkpoint)
    return rows.read(name)
