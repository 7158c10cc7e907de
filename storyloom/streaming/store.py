"""Tables that are written together, batch by batch, and read as of any batch.

A batch writes the rows of all its tables into folders of its own attempt, then one manifest file that names
them. Readers go by manifests alone, so they see whole batches; what a run has written before it was lost is named
nowhere. A batch that is there already is left as it is, so a stream may hand it in again.

``compact`` folds all batches up to one into a single snapshot; later reads take it and the batches after it.
Batches before it stay, so reads as of an earlier one give what they gave.

The driver reads the manifests, a row for each table of a batch since the last snapshot.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "number long, name string, path string, snapshot boolean"


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, empty where nothing was written yet; partition folders give columns that the schema names."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], schema)


class BatchStore:
    """``tables``: name -> DDL of the rows of each table. ``read`` adds their batch as ``batch``.

    ``folders``: name -> column of few values by which a table's rows lie in folders, of which a filter reads some.
    Manifests lie beside the tables, or where ``manifest`` says.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, str], folders: dict[str, str] | None = None, manifest: str | None = None):
        self.spark, self.folder, self.tables, self.folders = spark, folder.rstrip("/"), tables, folders or {}
        self.manifest = manifest or f"{self.folder}/manifest"

    def _entries(self, upto: int | None = None) -> list:
        found = read_if_there(self.spark, self.manifest, ENTRY)
        return sorted((r for r in found.collect() if upto is None or r["number"] <= upto), key=lambda r: r["number"])

    def batches(self) -> list[int]:
        """The numbers of the batches that are there, in order."""
        return sorted({r["number"] for r in self._entries() if not r["snapshot"]})

    def _write(self, number: int, kind: str, frames: dict[str, DataFrame]) -> None:
        attempt, entries = uuid.uuid4().hex, []
        for name, rows in frames.items():
            path = f"{self.folder}/{name}/{kind}-{number}-{attempt}"
            columns = self.spark.createDataFrame([], self.tables[name]).schema
            rows = rows.select(*[F.col(c.name).cast(c.dataType) for c in columns], *["batch"] * (kind == "snapshot"))
            by = [self.folders[name]] if name in self.folders else []
            (rows.repartition(*by) if by else rows).write.partitionBy(*by).parquet(path)
            entries.append((number, name, path, kind == "snapshot"))
        # One file, which appears by a rename when it is whole.
        self.spark.createDataFrame(entries, ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{self.manifest}/entry={kind}-{number}")

    def commit(self, number: int, frames: dict[str, DataFrame]) -> bool:
        """Write a batch; False if it is there already. Its number must be above all others."""
        there = self.batches()
        if number in there:
            return False
        if there and number < there[-1]:
            raise ValueError(f"batch {number} comes after batch {there[-1]}")
        self._write(number, "batch", frames)
        return True

    def read(self, name: str, upto: int | None = None) -> DataFrame:
        """Rows of a table with the ``batch`` that they came in, of all batches or those up to one."""
        entries = [r for r in self._entries(upto) if r["name"] == name]
        last = max((r for r in entries if r["snapshot"]), key=lambda r: r["number"], default=None)
        schema = self.tables[name]
        frames = [self.spark.read.schema(f"{schema}, batch long").parquet(last["path"])] if last else []
        frames += [
            self.spark.read.schema(schema).parquet(r["path"]).withColumn("batch", F.lit(r["number"]).cast("long"))
            for r in entries if not r["snapshot"] and (last is None or r["number"] > last["number"])
        ]
        if not frames:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        while len(frames) > 1:  # a shallow plan, however many batches there are
            frames = [frames[k].unionByName(frames[k + 1]) if k + 1 < len(frames) else frames[k] for k in range(0, len(frames), 2)]
        return frames[0].select(*self.spark.createDataFrame([], schema).columns, "batch")

    def latest(self, name: str, key: str, upto: int | None = None) -> DataFrame:
        """The last row of each key, without its batch: the state of a table whose rows replace earlier ones."""
        return last_of_key(self.read(name, upto), key).drop("batch")

    def compact(self, number: int, folds: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
        """Store ``fold(rows up to a batch)`` as the snapshot of tables.

        A fold takes rows with their batch and gives those that still matter: folded again together with later
        rows it must give what folding all rows gives.
        """
        if number not in self.batches():
            raise ValueError(f"no batch {number}")
        self._write(number, "snapshot", {name: fold(self.read(name, number)) for name, fold in folds.items()})


def last_of_key(rows: DataFrame, key: str) -> DataFrame:
    """The row of the last batch of each key; of one batch's rows of a key the largest. One partial aggregate a key."""
    others = [c for c in rows.columns if c not in (key, "batch")]
    best = F.max(F.struct("batch", *others)).alias("t")
    return rows.groupBy(key).agg(best).select(key, *[f"t.{c}" for c in others], "t.batch").select(*rows.columns)
