"""Codes of vectors: parts of a vector are replaced by the nearest entries of codebooks, found by bitmasks.

A codebook has at most 64 entries, so a set of entries is one uint64. For each dimension the entries' coordinates
are sorted, and beside each place stands the mask of the entries before it (prefix mask). A query with a radius
takes a range of each sorted dimension: the prefix at its end without that at its start. ANDed over the
dimensions this leaves the entries in the box around the query. The initial radius is the distance to the nearest of the
entries that stand beside the query in some dimension, so every entry that is as near or nearer is in the
box: the candidates are exact, ties among them. Their distances decide.

``fit`` runs rounds of k-means on integers: partial sums for each part and entry in every task, added up by Spark;
what reaches the driver are the codebooks (parts x entries), whatever the number of vectors.

Defined results: components become floor(256 * x), x as double; rows with a null vector, or null or non-finite
components, have no code and are left out. Entries start as the parts of the rows with the smallest ids; null
ids come last, rows of one id in order of their vectors; fewer rows make fewer entries. A vector whose length is no
multiple of the parts ends in zeros; one whose length differs from that of the row with the smallest id can't be compared: its
code and error are null. Repeated rows each get a row. Empty tables give empty results. Beyond 2**27 (after
flooring) a component makes the job fail, as sums would leave 64 bits. A label that a third of all rows share is summed by tasks
first and joined by counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import cut, join_counted

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a batch that are compared at once.
BLOCK = 2048
LARGEST = 1 << 27


def usable(vector: Column) -> Column:
    """Whether a vector has components, and all of them are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad)


def floored(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


class Book:
    """The entries of one part, with their sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0)
        bits = np.uint64(1) << self.order.astype(np.uint64)
        nothing = np.zeros((1, entries.shape[1]), np.uint64)
        self.prefix = np.concatenate([nothing, np.bitwise_or.accumulate(bits, axis=0)])

    def radius(self, parts: np.ndarray) -> np.ndarray:
        """Squared distance of each row to the nearest of the entries that are its neighbours in a dimension."""
        least = None
        for d in range(parts.shape[1]):
            at = np.searchsorted(self.sorted[:, d], parts[:, d])
            for beside in (np.maximum(at - 1, 0), np.minimum(at, len(self.entries) - 1)):
                found = self.distance(parts, self.order[beside, d])
                least = found if least is None else np.minimum(least, found)
        return least

    def distance(self, parts: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return np.square(parts - self.entries[entry]).sum(axis=1)

    def candidates(self, parts: np.ndarray, squared: np.ndarray) -> np.ndarray:
        """For each row the mask of the entries that no dimension puts beyond its radius."""
        # At least the root: a float root of a large square may fall short by rounding.
        reach = np.ceil(np.sqrt(squared.astype(np.float64))).astype(np.int64) + 1
        mask = np.full(len(parts), ~np.uint64(0))
        for d in range(parts.shape[1]):
            low = np.searchsorted(self.sorted[:, d], parts[:, d] - reach, side="left")
            high = np.searchsorted(self.sorted[:, d], parts[:, d] + reach, side="right")
            mask &= self.prefix[high, d] & ~self.prefix[low, d]
        return mask

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row; of equally near entries the first."""
        masks = self.candidates(parts, self.radius(parts)).astype("<u8")
        held = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, entry = np.nonzero(held)
        found = self.distance(parts[row], entry)
        starts = np.searchsorted(row, np.arange(len(parts)))
        least = np.minimum.reduceat(found, starts)
        first = np.minimum.reduceat(np.where(found == least[row], entry, ENTRIES), starts)
        return first, least


def _blocks(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) of the vectors in a column of a batch, all of ``width`` components."""
    values = batch.column(column)
    for at in range(0, batch.num_rows, BLOCK):
        part = values.slice(at, BLOCK)
        matrix = np.asarray(part.flatten()).reshape(len(part), width)
        if matrix.size and np.abs(matrix).max() > LARGEST:
            raise ValueError(f"a component is beyond {LARGEST} after flooring")
        yield at, matrix


def _padded(matrix: np.ndarray, parts: int) -> np.ndarray:
    more = -matrix.shape[1] % parts
    return np.pad(matrix, ((0, 0), (0, more))) if more else matrix


class Codebooks:
    """The codebooks of a set of vectors: ``entries`` is (parts, entries, width of a part)."""

    def __init__(self, entries: np.ndarray, width: int):
        self.entries, self.width = entries, width

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def assigned(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(parts, codes, squared distances) of each row and part."""
        parts = _padded(matrix, len(self.entries)).reshape(len(matrix), len(self.entries), -1)
        found = [Book(e).nearest(parts[:, k]) for k, e in enumerate(self.entries)]
        return parts, np.stack([x for x, _ in found], axis=1), np.stack([x for _, x in found], axis=1)

    def refined(self, vectors: DataFrame) -> Codebooks:
        """One round: every part goes to its nearest entry, which becomes the floored mean of its parts."""
        n_parts, n_entries, width = self.entries.shape

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n_parts * n_entries, width + 1), np.int64)
            for batch in batches:
                for _, matrix in _blocks(batch, 0, self.width):
                    parts, codes, _ = self.assigned(matrix)
                    cell = (codes + np.arange(n_parts) * n_entries).reshape(-1)
                    np.add.at(total, cell, np.concatenate([parts.reshape(len(cell), width), np.ones((len(cell), 1), np.int64)], axis=1))
            used = np.flatnonzero(total[:, -1])
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used), *map(pa.array, total[used].T)], ["cell", *names])

        names = [f"s{d}" for d in range(width)] + ["n"]
        partial = vectors.mapInArrow(sums, ", ".join(f"{x} long" for x in ["cell", *names]))
        entries = self.entries.reshape(-1, width).copy()
        for cell, *total, n in partial.groupBy("cell").agg(*[F.sum(x).alias(x) for x in names]).collect():  # parts x entries rows
            entries[cell] = [x // n for x in total]
        return Codebooks(entries.reshape(self.entries.shape), self.width)


def prepared(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v as integers."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    return rows.where(usable(F.col("v"))).withColumn("v", floored(F.col("v")))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of prepared rows; None if there are none."""
    if not 1 <= entries <= ENTRIES:
        raise ValueError("a mask holds 64 entries at most")
    first = [r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]
    if not first:
        return None
    width = len(first[0])
    start = _padded(np.array([x for x in first if len(x) == width], np.int64), parts)
    books = Codebooks(start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy(), width)
    alike = rows.where(F.size("v") == width).select("v")
    for _ in range(rounds):
        books = books.refined(alike)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of prepared rows; two hex digits for each part."""
    digits = np.array([f"{k:02x}" for k in range(ENTRIES)])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in _blocks(batch, 2, books.width):
                _, found, squared = books.assigned(matrix)
                text = pa.array(["".join(x) for x in digits[found].tolist()], pa.string())
                same = batch.slice(at, len(matrix))
                yield pa.RecordBatch.from_arrays([same.column(0), same.column(1), text, pa.array(squared.sum(axis=1))], ["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    coded = rows.where(F.size("v") == books.width).mapInArrow(codes, f"vec_id long, label {kind}, code string, error long")
    other = rows.where(F.size("v") != books.width).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(other)


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, books: Callable[[DataFrame], Codebooks | None] | None = None,
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every vector of ``df`` that takes part.

    ``label_error`` sums the errors of rows with one label, nulls together. ``books`` may give codebooks that were fitted before.
    """
    rows = prepared(df, id_col, vector_col, label_col)
    model = books(rows) if books else fit(rows, parts, entries, rounds)
    if model is None:
        kind = rows.schema["label"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded = cut(encode(rows, model)).withColumn("_key", F.to_json(F.struct("label")))
    summed = cut(coded.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    total = summed.agg(F.sum("n")).first()[0]
    told = join_counted(coded, summed, "_key", total)
    return told.select("vec_id", "label", "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))
