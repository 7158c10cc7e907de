"""An exact index of vectors by cosine: cells with a centre and a radius, passed over by the triangle inequality.

Vectors are made unit vectors, where a squared distance is 2 - 2 * cosine. Every vector is stored in the cell of its nearest
centre, with its distance to it. No member of a cell is nearer to a query than the query's distance to the centre less
the cell's radius; a cell for which that is more than what is looked for is passed over. The nearest vector is first
looked for in the query's own cell, and what is found there limits the cells that follow.

Centres are fitted on at most ``SAMPLE`` vectors (those whose ids have the smallest hashes) and are at most ``CELLS``, so they
and the cells' sizes go to every task. Members go by groups of cells that are near each other, of at most about ``MEMBERS`` rows, and a
cell of more members is several groups. A group is searched by shares of at most about ``QUERIES`` queries, each a task. Appended vectors go to the nearest of the same centres,
radii grow with them.

Defined results: null ids and null vectors take no part; a vector without length is 0 alike to everything; a row isn't its own
neighbour, rows of the same id neither; ties go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.graph import cut
from storyloom.streaming.store import BatchStore

CELLS, SAMPLE, ROUNDS = 1024, 16_384, 4
MEMBERS, QUERIES, STEP = 32_768, 32_768, 256
#: Bytes of vectors that a task holds of a group, and of a share of the queries; pairs that are looked at once more at a time.
HELD_BYTES, PAIRS = 1 << 24, 1 << 14
#: What rounding may move a similarity or a distance by.
SLACK = 1e-9
MEMBER = "id long, cell int, distance double, unit binary"
TABLES = {"centres": "cell int, centre array<double>", "members": MEMBER}


def unit_rows(rows: list) -> np.ndarray:
    """Rows divided by their lengths; those without length stay zero."""
    matrix = np.asarray(rows, dtype=np.float64).reshape(len(rows), -1 if len(rows) else 0)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(n, -1)


def fit_centres(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """Centres of cells by k-means on a sample, about the square root of the number of rows, ``cells`` at most."""
    known = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    n = known.count()
    taken = unit_rows([r["vector"] for r in known.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()])
    if not len(taken):
        return np.zeros((1, 0))
    centres = taken[:: max(len(taken) // max(min(cells, round(n**0.5)), 1), 1)][:cells].copy()
    for _ in range(ROUNDS):
        own = _distances(taken, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, taken)
        count = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres


class VectorIndex:
    """Members (id, cell, distance, unit) of cells around ``centres``; vectors without length are in cell -1."""

    def __init__(self, centres: np.ndarray, members: DataFrame):
        self.centres, self.members = centres, members
        told = members.where("cell >= 0").groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect()  # a row for each cell
        self.radius, self.size = np.full(len(centres), -1.0), np.zeros(len(centres), np.int64)
        for cell, radius, n in told:
            self.radius[cell], self.size[cell] = radius, n

    @classmethod
    def build(cls, rows: DataFrame, cells: int = CELLS) -> VectorIndex:
        centres = fit_centres(rows, cells)
        return cls(centres, cut(assigned(rows, centres)))

    def _dealt(self) -> tuple[np.ndarray, np.ndarray]:
        """(group, parts) of each cell: cells near each other share a group of at most ``_most(MEMBERS)`` rows; a larger cell has as many groups as it needs."""
        most, middle = self._most(MEMBERS), self.centres - self.centres.mean(axis=0)
        along = middle @ np.linalg.svd(middle, full_matrices=False)[2][0] if min(middle.shape) > 1 else np.zeros(len(middle))
        group, parts, at, held = np.zeros(len(middle), np.int64), np.ones(len(middle), np.int64), 0, 0
        for cell in np.argsort(along, kind="stable"):
            n = int(self.size[cell])
            if held and held + n > most:
                at, held = at + 1, 0
            group[cell], parts[cell], held = at, max(-(-n // most), 1), held + n
            if n > most:
                at, held = at + parts[cell], 0
        return group, parts

    def _most(self, rows: int) -> int:
        """So many rows at most, fewer where vectors are long."""
        return max(min(rows, HELD_BYTES // (8 * max(self.centres.shape[1], 1))), 1)

    def _asked(self, queries: DataFrame, cells: str) -> DataFrame:
        """(id, group, cells, unit): the groups that each query has to look into, and which cells there.

        ``queries`` has id, unit and ``limit``, the distance up to which rows are looked for. ``cells`` is "home" for the one whose
        centre is nearest (of those that have members), "within" for all that the limit doesn't pass over, "further" for
        these without the home. A query goes once to a group, however many of its cells it needs.
        """
        centres, radius, some, (groups, parts) = self.centres, self.radius, bool(self.size.any()), self._dealt()

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches if some else ():
                for at in range(0, batch.num_rows, STEP):
                    part = batch.slice(at, STEP)
                    far = np.where(radius < 0, np.inf, _distances(_matrix(part.column(1), len(part)), centres))
                    home = far.argmin(axis=1)
                    if cells == "home":
                        row, cell = np.flatnonzero(np.isfinite(far.min(axis=1))), None
                        cell = home[row]
                    else:
                        near = far - radius[None, :] <= np.asarray(part.column(2))[:, None] + SLACK
                        if cells == "further":
                            near[np.arange(len(part)), home] = False
                        row, cell = np.nonzero(near)
                    times = parts[cell]
                    row, cell, nth = np.repeat(row, times), np.repeat(cell, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    group = groups[cell] + nth
                    order = np.lexsort((cell, group, row))
                    row, cell, group = row[order], cell[order], group[order]
                    first = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(group, prepend=-1))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(cell, pa.int32()))
                    picked = part.take(pa.array(row[first]))
                    yield pa.RecordBatch.from_arrays([picked.column(0), pa.array(group[first], pa.int32()), lists, picked.column(1)], ["id", "group", "cells", "unit"])

        return queries.select("id", "unit", "limit").mapInArrow(route, "id long, group int, cells array<int>, unit binary")

    def compared(self, asked: DataFrame) -> int:
        """How many pairs of a query and a member the cells in ``asked`` stand for."""
        n = asked.select(F.explode(F.array_distinct("cells")).alias("cell"), "id").distinct().groupBy("cell").agg(F.count("*").alias("n"))
        return int(sum(self.size[r["cell"]] * r["n"] for r in n.collect()))

    def _searched(
        self, queries: DataFrame, cells: str, n: int, threshold: float | None = None, upwards: bool = False, least: float = -np.inf, earlier: bool = False
    ) -> DataFrame:
        """(id, other, similarity) of ``n`` queries (id, unit, limit), group by group: all pairs at least ``threshold`` alike, ``upwards`` those with
        larger ids only; without a threshold each query's most similar member of a group, if about ``least`` alike, ``earlier`` of those with smaller ids.

        A task takes one group and one share of the queries, so each vector is sent once for each share or group, not for each cell.
        """
        groups, parts = self._dealt()
        chunks = max(-(-n // self._most(QUERIES)), 1)
        left = self._asked(queries, cells).select(
            F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), "group", "cells", "id", "unit", F.lit(True).alias("asks")
        )
        own = F.element_at(F.lit(groups.tolist()), F.col("cell") + 1) + F.pmod(F.xxhash64("id"), F.element_at(F.lit(parts.tolist()), F.col("cell") + 1))
        right = self.members.where("cell >= 0").select(
            F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), own.cast("int").alias("group"), F.array("cell").alias("cells"), "id", "unit",
            F.lit(False).alias("asks"),
        )

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sides: tuple[list, list] = ([], [])
            for batch in batches:
                asks = batch.column("asks")
                for side, mask in zip(sides, (pc.invert(asks), asks), strict=True):
                    if len(rows := batch.filter(mask)):
                        side.append((np.asarray(rows.column("id")), rows.column("cells"), _matrix(rows.column("unit"), len(rows))))
            if not all(sides):
                return
            (ids, cell, rows), (own, asked, unit) = ((np.concatenate([x[0] for x in side]), [x[1] for x in side], np.concatenate([x[2] for x in side])) for side in sides)
            cell = np.concatenate([np.asarray(x.flatten()) for x in cell])
            order = np.argsort(cell, kind="stable")
            ids, rows, cell = ids[order], rows[order], cell[order]
            there, start = np.unique(cell, return_index=True)
            start = np.append(start, len(cell))
            lengths = np.concatenate([np.asarray(x.value_lengths()) for x in asked])
            wants, wanted = np.repeat(np.arange(len(own)), lengths), np.concatenate([np.asarray(x.flatten()) for x in asked])
            for at in range(0, len(own), STEP):
                low, high = np.searchsorted(wants, (at, at + STEP))
                found = []
                for k in np.flatnonzero(np.isin(there, wanted[low:high])):
                    q, m = wants[low:high][wanted[low:high] == there[k]], slice(start[k], start[k + 1])
                    sim = unit[q] @ rows[m].T
                    if threshold is None:
                        sim[own[q][:, None] <= ids[m][None, :] if earlier else own[q][:, None] == ids[m][None, :]] = -np.inf
                        x, y = np.nonzero((sim >= np.maximum(sim.max(axis=1, keepdims=True), least) - SLACK) & np.isfinite(sim))
                    else:
                        x, y = np.nonzero(sim >= threshold - SLACK)
                        keep = own[q][x] < ids[m][y] if upwards else own[q][x] != ids[m][y]
                        x, y = x[keep], y[keep]
                    found.append((q[x], y + start[k]))
                x, y = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
                # Once more pair by pair, so that equal vectors are equally alike whatever block they are in.
                exact = np.empty(len(x))
                for k in range(0, len(x), PAIRS):
                    exact[k : k + PAIRS] = (unit[x[k : k + PAIRS]] * rows[y[k : k + PAIRS]]).sum(axis=1)
                if threshold is None:
                    order = np.lexsort((ids[y], -exact, x))
                    order = order[np.flatnonzero(np.diff(x[order], prepend=-1))]
                    x, y, exact = x[order], y[order], exact[order]
                for k in range(0, len(x), PAIRS):
                    p, q = x[k : k + PAIRS], y[k : k + PAIRS]
                    yield pa.RecordBatch.from_arrays([pa.array(own[p]), pa.array(ids[q]), pa.array(exact[k : k + PAIRS])], ["id", "other", "similarity"])

        return left.unionByName(right).groupBy("group", "chunk").applyInArrow(search, "id long, other long, similarity double")

    def within(self, queries: DataFrame, threshold: float, upwards: bool = False) -> DataFrame:
        """(id, other, similarity) of all members at least ``threshold`` (above 0) alike; ``upwards``: of larger ids only."""
        if threshold <= 0:
            raise ValueError("a threshold above zero is needed")
        limit = float(np.sqrt(max(2 - 2 * threshold, 0)))
        units = cut(as_units(queries).where("full").withColumn("limit", F.lit(limit)))
        return self._searched(units, "within", units.count(), threshold, upwards).where(F.col("similarity") >= threshold)

    def best_within(self, queries: DataFrame, threshold: float, earlier: bool = False) -> DataFrame:
        """(id, nearest_id, similarity) of the most similar other member of each query, if ``threshold`` (above 0) alike; ``earlier``: of smaller ids only.

        One pass: the threshold alone limits the cells, so a query is sent once to a group, and no pair but the best ones comes out.
        """
        if threshold <= 0:
            raise ValueError("a threshold above zero is needed")
        limit = float(np.sqrt(max(2 - 2 * threshold, 0)))
        units = as_units(queries).where("full").withColumn("limit", F.lit(limit))
        found = self._searched(units, "within", queries.count(), least=threshold, earlier=earlier).where(F.col("similarity") >= threshold)
        best = found.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("other")).alias("minus"))).alias("t"))
        return best.select("id", (-F.col("t.minus")).alias("nearest_id"), F.col("t.similarity").alias("similarity"))

    def nearest(self, queries: DataFrame, least: float = -1.0) -> DataFrame:
        """(id, nearest_id, similarity) of the most similar other member of each query."""
        top = F.max(F.struct("similarity", (-F.col("other")).alias("minus"))).alias("t")
        units = cut(as_units(queries).withColumn("limit", F.lit(2.0)))
        full, n = units.where("full"), units.count()
        first = cut(self._searched(full, "home", n).groupBy("id").agg(top))
        limit = F.coalesce(F.sqrt(F.greatest(2 - 2 * F.col("t.similarity"), F.lit(0.0))), F.lit(2.0))
        left = full.drop("limit").join(first, "id", "left").select("id", "unit", limit.alias("limit"))
        second = self._searched(left, "further", n)
        found = first.select("id", (-F.col("t.minus")).alias("other"), F.col("t.similarity").alias("similarity")).unionByName(second)
        found = found.unionByName(self._without_length(units))
        one = found.groupBy("id").agg(top)
        return one.select("id", (-F.col("t.minus")).alias("nearest_id"), F.col("t.similarity").alias("similarity")).where(F.col("similarity") >= least)

    def _without_length(self, units: DataFrame) -> DataFrame:
        """(id, other, 0.0): for each query the first member without length, for queries without length the first of all."""
        first = lambda df: [r["id"] for r in df.select("id").distinct().orderBy("id").limit(2).collect()]
        empty, every = (F.array(*[F.lit(x) for x in first(df)]).cast("array<long>") for df in (self.members.where("cell < 0"), self.members))
        other = F.get(F.filter(F.when(F.col("full"), empty).otherwise(every), lambda x: x != F.col("id")), F.lit(0))
        return units.select("id", other.alias("other"), F.lit(0.0).alias("similarity")).where("other IS NOT NULL")


def as_units(rows: DataFrame) -> DataFrame:
    """(id, unit, full) of rows (id, vector); full tells whether the vector has a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = unit_rows(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in unit], pa.binary()), pa.array(unit.any(axis=1))], ["id", "unit", "full"])

    known = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    return known.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, "id long, unit binary, full boolean")


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows (id, vector) as members of the cells of their nearest centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                far = _distances(_matrix(part.column(1), len(part)), centres)
                cell = np.where(np.asarray(part.column(2)), far.argmin(axis=1), -1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cell, pa.int32()), pa.array(far.min(axis=1)), part.column(1)], ["id", "cell", "distance", "unit"])

    return as_units(rows).select("id", "unit", "full").mapInArrow(run, MEMBER)


class StoredIndex:
    """An index in two tables of a batch store, ``centres`` and ``members``: centres of the first rows, members of all batches."""

    def __init__(self, store: BatchStore):
        self.store = store

    def centres(self) -> np.ndarray | None:
        found = [r["centre"] for r in self.store.read("centres").orderBy("cell").collect()]
        return np.array(found) if found else None

    def open(self, upto: int | None = None) -> VectorIndex | None:
        centres = self.centres()
        return None if centres is None else VectorIndex(centres, self.store.read("members", upto).drop("batch"))

    def added(self, rows: DataFrame) -> dict[str, DataFrame]:
        """The rows to commit for new vectors (id, vector); with the first ones come the centres."""
        centres, frames, spark = self.centres(), {}, rows.sparkSession
        if centres is None:
            centres = fit_centres(rows)
            if centres.shape[1]:
                frames["centres"] = spark.createDataFrame(list(enumerate(centres.tolist())), TABLES["centres"])
        return frames | {"members": assigned(rows, centres)}
