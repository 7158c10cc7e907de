"""Counts that are kept up to date: batches of changed rows become signed deltas of stored partial sums.

A row counts for some (name, key) pairs. When a batch brings another state of a row, what its last state counted for is
taken away and what the new one counts for is added; a flag that flips is -1 here and +1 there. Rows and deltas are
committed together, so a batch that is run again changes nothing. Sums are read from the deltas alone.

Rows are stored in ``BUCKETS`` folders by the hash of their id; a batch reads the folders of the ids that it has only.
Null ids take no part; of a batch's rows of one id the largest counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.graph import cut
from storyloom.streaming.store import BatchStore, last_of_key

BUCKETS = 64
DELTA = "name string, key string, n long"


def facet(row: Callable[[str], Column]) -> list[tuple[str, Column, Column]]:
    """A row counts for its source unless it is skipped."""
    return [("facet", row("source_type"), (~row("skipped")).cast("long"))]


def story_stats(row: Callable[[str], Column]) -> list[tuple[str, Column, Column]]:
    """A story counts once, once if it has news, and on its day if it is unread. Days end with midnight."""
    day = F.floor((row("last_updated") - 1) / 86400).cast("string")
    return [
        ("stories", F.lit(""), F.lit(1).cast("long")), ("evolved", F.lit(""), (row("new_info_count") > 0).cast("long")),
        ("unread", day, (~row("is_read")).cast("long")),
    ]


class KeptCounts:
    """Counts of the last states of rows (``schema``, with ``id``) under a folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, counted: Callable[[Callable[[str], Column]], list[tuple[str, Column, Column]]], id_col: str = "id"):
        self.id, self.counted = id_col, counted
        self.store = BatchStore(spark, folder, {"rows": f"{schema}, bucket int", "deltas": DELTA}, {"rows": "bucket"})

    def _deltas(self, rows: DataFrame, sign: int) -> DataFrame:
        entries = [F.struct(F.lit(name).alias("name"), F.coalesce(key.cast("string"), F.lit("")).alias("key"), (sign * F.coalesce(n, F.lit(0))).alias("n")) for name, key, n in self.counted(F.col)]
        return rows.select(F.explode(F.array(*entries)).alias("d")).select("d.*").where("n <> 0")

    def apply(self, rows: DataFrame, number: int) -> bool:
        """Take a batch of rows in; False if it was taken before."""
        if number in self.store.batches():
            return False
        bucket = F.pmod(F.xxhash64(self.id), F.lit(BUCKETS)).cast("int")
        new = rows.where(F.col(self.id).isNotNull()).withColumns({"bucket": bucket, "batch": F.lit(number).cast("long")})
        new = cut(last_of_key(new, self.id).drop("batch"))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        before = self.store.read("rows").where(F.col("bucket").isin(touched)).join(new.select(self.id), self.id, "left_semi")
        before = last_of_key(before, self.id).drop("batch")
        deltas = self._deltas(new, 1).unionByName(self._deltas(before, -1)).groupBy("name", "key").agg(F.sum("n").alias("n")).where("n <> 0")
        return self.store.commit(number, {"rows": new, "deltas": deltas})

    def counts(self, upto: int | None = None) -> DataFrame:
        """(name, key, n) of all counts that aren't zero, now or as of a batch."""
        return self.store.read("deltas", upto).groupBy("name", "key").agg(F.sum("n").alias("n")).where("n <> 0")

    def shorten(self, number: int) -> None:
        """Fold rows and deltas of all batches up to one."""
        folded = lambda d: d.groupBy("name", "key").agg(F.sum("n").alias("n"), F.max("batch").alias("batch"))
        self.store.compact(number, {"rows": lambda r: last_of_key(r, self.id), "deltas": folded})


def facets(counts: DataFrame) -> DataFrame:
    """(source_type, n), most first, as ``feed.facets`` counts them."""
    return counts.where("name = 'facet'").select(F.col("key").alias("source_type"), "n").orderBy(F.desc("n"), "source_type")


def stats(counts: DataFrame, midnight: int, days: int = 30) -> DataFrame:
    """One row (stories, evolved, unread_<days>_days) at a midnight, as ``feed.stats`` counts stories."""
    total = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)).cast("long")
    recent = (F.col("name") == "unread") & (F.col("key").cast("long") >= midnight // 86400 - days)
    return counts.agg(
        total(F.col("name") == "stories").alias("stories"), total(F.col("name") == "evolved").alias("evolved"), total(recent).alias(f"unread_{days}_days")
    )
