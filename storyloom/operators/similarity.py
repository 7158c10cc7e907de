"""Vector search and similarity pairs.

``nearest`` is exact, by cells that the triangle inequality passes over (``vector_index``). ``similar_pairs`` finds pairs above
a threshold by random hyperplanes with enough bands for a wanted recall, and verifies each candidate. Where no pair may be
missed, or the threshold is so low that the bands would compare more than that, ``exact=True`` goes by cells too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators.vector_index import VectorIndex, unit_rows

BUCKET = 256


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(queries: DataFrame, rows: DataFrame | VectorIndex, least: float = -1.0) -> DataFrame:
    """(id, nearest_id, similarity): the most similar other row of each query; ties go to the smallest id.

    Both inputs are (id, vector); ``rows`` may be an index that is there already.
    """
    return (rows if isinstance(rows, VectorIndex) else VectorIndex.build(rows)).nearest(queries, least)


def bands(threshold: float, recall: float = 0.999, bits: int = 8) -> tuple[int, int]:
    """(bits of a band, bands) so that a pair at the threshold shares a band with the wanted probability."""
    same = (1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(same, 1 - 1e-12))))


def similar_pairs(rows: DataFrame, threshold: float, recall: float = 0.999, bits: int = 8, seed: int = 7, exact: bool = False) -> DataFrame:
    """(a, b, similarity) with a < b of the rows (id, vector) at least ``threshold`` alike.

    Rows with one band in common meet in a bucket. Buckets are cut in pairs of blocks of ``BUCKET`` rows, so a
    large one is many tasks' work and none holds it.
    """
    if exact:
        found = VectorIndex.build(rows).within(rows, threshold, upwards=True)
        return found.select(F.col("id").alias("a"), F.col("other").alias("b"), "similarity")
    width, count = bands(threshold, recall, bits)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(batch.column(1).to_pylist())
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(unit.shape[1], width * count))
            signs = (unit @ planes > 0).reshape(len(unit), count, width)
            code = (signs << np.arange(width)).sum(axis=2) + (np.arange(count) << width)
            ids = np.repeat(np.array(batch.column(0).to_pylist()), count)
            vectors = [x for x in unit.tolist() for _ in range(count)]
            yield pa.RecordBatch.from_arrays([pa.array(code.reshape(-1)), pa.array(ids), pa.array(vectors, pa.list_(pa.float64()))], ["key", "id", "unit"])

    hashed = rows.where(F.col("vector").isNotNull() & F.col("id").isNotNull()).mapInArrow(keys, "key long, id long, unit array<double>")
    sizes = hashed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    own = hashed.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / BUCKET).cast("int"))
    own = own.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "unit"
    )

    def verify(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("id").to_pylist())
        unit = np.array(group.column("unit").to_pylist())
        sim = unit @ unit.T
        x, y = np.nonzero((sim >= threshold - 1e-12) & (ids[:, None] < ids[None, :]))
        return pa.table({"a": ids[x], "b": ids[y], "similarity": sim[x, y]})

    found = paired.groupBy("key", "i", "j").applyInArrow(verify, "a long, b long, similarity double")
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")).where(F.col("similarity") >= threshold)
