"""Hard negatives by inner product, from R-trees packed by sort-tile-recursive (STR).

1. ``packed``: rows are dealt out by range of label and the widest coordinate and cut into tiles; a tile is sorted and cut
   by further coordinates in turn (STR) into leaves, each stored as a row with its minimum bounding box.
2. ``routed``: for an anchor q, a box [lo, hi] bounds every inner product inside: of each coordinate the smaller and
   the larger of q*lo and q*hi, summed. Blocks of anchors meet blocks of the tiles' boxes; pairs whose interval
   misses all score windows go.
3. ``searched``: anchors and the leaves of a tile meet in a task, which builds the tree above the leaves and walks it
   from the box with the highest bound on. A box is passed over if its labels don't fit, its interval lies outside
   every window, or what it can give to a window is strictly below the kth best score found.
4. ``best``: each anchor is searched in its most promising tile first; the kth score found there keeps it from tiles
   that can't reach it. Equal scores are never passed over, as ties go to the smaller id.

Anchors are a stated set and meet rows in blocks (``ANCHORS`` to a tile's ``TILE`` rows at most in one task). Boxes say
little of vectors spread evenly over many dimensions: then all tiles are searched, and the result is the same.

Defined results: components become floor(256 * x); rows without an id, a label or a vector, or with null or
non-finite components, take no part. Exact repeats (id, label and vector) are one row; other rows of one id are rows of
their own, none of which is "other" to an anchor of that id, and equal scores and ids come in order of labels. Missing components of
shorter vectors are zero. Empty tables, anchors without positives and positives without negatives give no rows. Sums are exact:
in doubles below 2**53, else in 64-bit integers; from 2**56 on the job fails. A label or vector that a third of all rows share is
cut into tiles like any other, as the id is the last sort key.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import cut
from storyloom.llm.vector_codes import LARGEST, floored, usable

TILE, LEAF, FAN = 8192, 128, 8
#: Anchors and boxes of a task.
ANCHORS, BOXES = 4096, 1024
#: Coordinates after which a tile is cut; anchors whose bounds are computed together.
AXES, STEP = 3, 512
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def rows_of(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(id, label, v) of the rows that take part."""
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).withColumn("v", floored(F.col("v")))


class Shape:
    """What holds for all rows: their number, components, kind of numbers that keeps products exact, and widest coordinates."""

    def __init__(self, rows: DataFrame):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, list] = {}
            for batch in batches:
                flat = np.asarray(batch.column(0).flatten())
                sizes = np.asarray(batch.column(0).value_lengths())
                at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                for d in np.unique(at).tolist():
                    x = flat[at == d].astype(np.float64)
                    n, s, q, most = found.get(d, (0, 0.0, 0.0, 0.0))
                    found[d] = [n + len(x), s + x.sum(), q + np.square(x).sum(), max(most, np.abs(x).max())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *[pa.array([x[k] for x in found.values()]) for k in range(4)]], ["d", "n", "s", "q", "most"])

        each = rows.select("v").mapInArrow(sums, "d int, n long, s double, q double, most double")
        told = each.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("most").alias("most")).collect()  # a row for each dimension
        self.width = max((r["d"] + 1 for r in told), default=0)
        self.n = max((r["n"] for r in told), default=0)
        largest = int(max((r["most"] for r in told), default=0))
        if largest > LARGEST or self.width * largest**2 >= 1 << 56:
            raise ValueError("inner products of these components leave 64 bits")
        self.kind = np.float64 if self.width * largest**2 < 1 << 53 else np.int64
        spread = {r["d"]: r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in told}
        self.axes = sorted(spread, key=lambda d: (-spread[d], d))[: AXES + 1]


def str_order(keys: np.ndarray, size: int) -> np.ndarray:
    """Row numbers in STR order: cut into slabs of equal numbers along the first key, each slab along the next."""
    leaves = -(-len(keys) // size)
    if keys.shape[1] == 0 or leaves <= 1:
        return np.arange(len(keys))
    order = np.argsort(keys[:, 0], kind="stable")
    if keys.shape[1] == 1:
        return order
    slab = -(-leaves // int(np.ceil(leaves ** (1 / keys.shape[1])))) * size
    return np.concatenate([order[at : at + slab][str_order(keys[order[at : at + slab], 1:], size)] for at in range(0, len(order), slab)])


_LEAF = "tile long, leaf int, ids array<long>, labels array<long>, data binary, lo binary, hi binary, label_lo long, label_hi long"


def packed(rows: DataFrame, shape: Shape, tile_rows: int = TILE, leaf_rows: int = LEAF) -> DataFrame:
    """The leaves of all tiles as stored rows, and for each tile one row with leaf -1 that has its box."""
    width, axes = shape.width, shape.axes

    def tile(number: int, ids: list[int], labels: list[int], matrix: np.ndarray) -> pa.RecordBatch:
        ids, labels = np.array(ids), np.array(labels)
        keys = [labels] * int(labels.min() < labels.max()) + [matrix[:, d] for d in axes[1:]]
        order = str_order(np.stack(keys, axis=1) if keys else np.empty((len(ids), 0)), leaf_rows)
        ids, labels, matrix = ids[order], labels[order], matrix[order]
        found = []
        for k, at in enumerate([None, *range(0, len(ids), leaf_rows)], -1):
            part = slice(None) if at is None else slice(at, at + leaf_rows)
            m, own = matrix[part], labels[part]
            held = ([], [], b"") if at is None else (ids[part].tolist(), own.tolist(), m.tobytes())
            found.append((number, k, *held, m.min(axis=0).tobytes(), m.max(axis=0).tobytes(), int(own.min()), int(own.max())))
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], [x.split()[0] for x in _LEAF.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, labels, data, last = TaskContext.get().partitionId() << 32, [], [], [], None
        seen: set = set()
        for batch in batches:
            for row, label, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                v = np.array([*v, *[0] * (width - len(v))], np.int32)
                now = (row, label, v.tobytes())
                if last is not None and now[:2] == last[:2] and now in seen:
                    continue
                if last is None or now[:2] != last[:2]:
                    seen = set()
                seen.add(now)
                last = now
                ids.append(row), labels.append(label), data.append(v)
                if len(ids) == tile_rows:
                    yield tile(number, ids, labels, np.stack(data))
                    number, ids, labels, data = number + 1, [], [], []
        if ids:
            yield tile(number, ids, labels, np.stack(data))

    first = F.coalesce(F.get("v", F.lit(axes[0] if axes else 0)), F.lit(0))
    keyed = rows.withColumn("_first", first)
    dealt = keyed.repartitionByRange(max(-(-shape.n // tile_rows), 1), "label", "_first", "id").sortWithinPartitions("label", "_first", "id")
    return cut(dealt.select("id", "label", "v").mapInArrow(pack, _LEAF))


class Tree:
    """Boxes above the leaves of a tile, ``FAN`` children each, the root last."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, label_lo: np.ndarray, label_hi: np.ndarray):
        levels, children = [(lo, hi, label_lo, label_hi)], [None] * len(lo)
        at = 0
        while len(levels[-1][0]) > 1:
            below = levels[-1]
            starts = np.arange(0, len(below[0]), FAN)
            children += [range(at + s, at + min(s + FAN, len(below[0]))) for s in starts.tolist()]
            at += len(below[0])
            levels.append(tuple(f.reduceat(x, starts, axis=0) for f, x in zip((np.minimum, np.maximum, np.minimum, np.maximum), below, strict=True)))
        self.children = children
        self.lo, self.hi, self.label_lo, self.label_hi = (np.concatenate(x) for x in zip(*levels, strict=True))


def intervals(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) inner product of each query with anything in each box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


def _fits(label: int, lo: np.ndarray, hi: np.ndarray, same: bool) -> np.ndarray:
    return (lo <= label) & (label <= hi) if same else (lo != label) | (hi != label)


def _matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, width).astype(kind)


class Walk:
    """Best-first walks of one tile for anchors that look for their k best rows in each of their windows."""

    def __init__(self, leaves: pa.Table, width: int, kind: type, k: int, same: bool):
        leaves = leaves.take(pa.array(np.argsort(np.asarray(leaves.column("leaf")))))
        self.k, self.same = k, same
        self.ids = [np.array(x) for x in leaves.column("ids").to_pylist()]
        self.labels = [np.array(x) for x in leaves.column("labels").to_pylist()]
        self.data = [np.frombuffer(x, np.int32).reshape(-1, width).astype(kind) for x in leaves.column("data").to_pylist()]
        box = [_matrix(leaves.column(x), width, kind) for x in ("lo", "hi")]
        self.tree = Tree(*box, *(np.asarray(leaves.column(x)) for x in ("label_lo", "label_hi")))

    def found(self, row: int, label: int, q: np.ndarray, lows: list, highs: list, floors: list, lower: np.ndarray, upper: np.ndarray) -> list[list[tuple]]:
        """For each window its k best (-score, id, label). ``floors``: scores that must be reached; lower, upper: the boxes' intervals."""
        best: list[list[tuple]] = [[] for _ in lows]
        least = [max(low, floor) for low, floor in zip(lows, floors, strict=True)]  # grows to the kth score
        fits = _fits(label, self.tree.label_lo, self.tree.label_hi, self.same).tolist()
        lower, upper, windows = lower.tolist(), upper.tolist(), range(len(lows))
        wanted = lambda node: fits[node] and any(upper[node] >= least[w] and lower[node] <= highs[w] and highs[w] >= least[w] for w in windows)
        root = len(upper) - 1
        queue = [(-upper[root], root)] if wanted(root) else []
        while queue:
            _, node = heapq.heappop(queue)
            if not wanted(node):
                continue
            if (below := self.tree.children[node]) is not None:
                for child in below:
                    if wanted(child):
                        heapq.heappush(queue, (-upper[child], child))
                continue
            scores = self.data[node] @ q
            other = (self.labels[node] == label) == self.same
            other &= self.ids[node] != row
            for w in windows:
                held = np.flatnonzero(other & (scores >= least[w]) & (scores <= highs[w]))
                if len(held):
                    more = zip((-scores[held]).astype(np.int64).tolist(), self.ids[node][held].tolist(), self.labels[node][held].tolist(), strict=True)
                    best[w] = heapq.nsmallest(self.k, [*best[w], *more])
                    if len(best[w]) == self.k:
                        least[w] = max(least[w], -best[w][-1][0])
        return best


def _chunks(asked: DataFrame) -> tuple[DataFrame, int]:
    n = max(-(-asked.count() // ANCHORS), 1)
    return asked.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")), n


def routed(asked: DataFrame, tiles: DataFrame, shape: Shape, same: bool) -> DataFrame:
    """(uid, tile, upper): the tiles that an anchor's windows may find rows in, with the highest score there.

    ``asked`` has uid, id, label, q, lows, highs. Anchors and boxes meet in blocks.
    """
    boxes = tiles.where("leaf = -1").select("tile", "lo", "hi", "label_lo", "label_hi")
    slices = max(-(-boxes.count() // BOXES), 1)
    asked, chunks = _chunks(asked)
    width, kind = shape.width, shape.kind

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        uids, numbers, uppers = [], [], []
        if left.num_rows and right.num_rows:
            lo, hi = (_matrix(right.column(x), width, kind) for x in ("lo", "hi"))
            label_lo, label_hi, tile = (np.asarray(right.column(x)) for x in ("label_lo", "label_hi", "tile"))
            for at in range(0, left.num_rows, STEP):
                part = left.slice(at, STEP)
                lower, upper = intervals(_matrix(part.column("q"), width, kind), lo, hi)
                for k, (uid, label, lows, highs) in enumerate(zip(*(part.column(x).to_pylist() for x in ("uid", "label", "lows", "highs")), strict=True)):
                    meets = ((upper[k][:, None] >= np.array(lows)) & (lower[k][:, None] <= np.array(highs))).any(axis=1)
                    here = np.flatnonzero(meets & _fits(label, label_lo, label_hi, same))
                    uids.append(np.full(len(here), uid)), numbers.append(tile[here]), uppers.append(upper[k][here].astype(np.int64))
        joined = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.table({"uid": pa.array(joined(uids), pa.int64()), "tile": pa.array(joined(numbers), pa.int64()), "upper": pa.array(joined(uppers), pa.int64())})

    left = asked.select("uid", "label", "q", "lows", "highs", "chunk", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part"))
    right = boxes.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(slices)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return cut(left.groupBy("chunk", "part").cogroup(right.groupBy("chunk", "part")).applyInArrow(route, "uid long, tile long, upper long"))


def searched(asked: DataFrame, pairs: DataFrame, tiles: DataFrame, shape: Shape, k: int, same: bool) -> DataFrame:
    """(uid, w, score, id, label): the k best rows of each of an anchor's windows in each of the tiles that ``pairs`` (uid, tile) name."""
    asked, chunks = _chunks(asked)
    width, kind = shape.width, shape.kind

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            walk = Walk(right, width, kind, k, same)
            for at in range(0, left.num_rows, STEP):
                part = left.slice(at, STEP)
                q = _matrix(part.column("q"), width, kind)
                lower, upper = intervals(q, walk.tree.lo, walk.tree.hi)
                given = zip(*(part.column(x).to_pylist() for x in ("uid", "id", "label", "lows", "highs", "floors")), strict=True)
                for n, (uid, row, label, lows, highs, floors) in enumerate(given):
                    for w, best in enumerate(walk.found(row, label, q[n], lows, highs, floors, lower[n], upper[n])):
                        out += [(uid, w, -score, other, its) for score, other, its in best]
        columns = zip(*out, strict=True) if out else [[]] * 5
        kinds = [("uid", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("label", pa.int64())]
        return pa.table({name: pa.array(list(c), t) for (name, t), c in zip(kinds, columns, strict=True)})

    left = pairs.select("uid", "tile").join(asked, "uid")
    right = tiles.where("leaf >= 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return left.groupBy("tile", "chunk").cogroup(right.groupBy("tile", "chunk")).applyInArrow(search, "uid long, w int, score long, id long, label long")


def best(asked: DataFrame, tiles: DataFrame, shape: Shape, k: int, same: bool) -> DataFrame:
    """(uid, w, rank, score, id): the k best rows of each window of each anchor; equal scores by id.

    ``asked`` has uid, id, label, q and the windows' lows and highs; ``same`` says whether rows of the anchor's own label are
    looked for or those of all others.
    """
    pairs = routed(asked, tiles, shape, same)
    home = pairs.groupBy("uid").agg(F.max(F.struct("upper", "tile")).alias("t")).select("uid", F.col("t.tile").alias("tile"))
    home = cut(home)
    lowest = F.transform("lows", lambda _: F.lit(LOWEST))
    near = cut(searched(asked.withColumn("floors", lowest), home, tiles, shape, k, same))
    kth = near.groupBy("uid", "w").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    known = kth.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("known"))
    floors = F.transform("lows", lambda _, w: F.coalesce(F.try_element_at("known", w), F.lit(LOWEST)))
    told = cut(asked.join(known, "uid", "left").withColumn("floors", floors).drop("known"))
    least = F.zip_with("lows", "floors", lambda a, b: F.greatest(a, b))
    within = F.exists(F.zip_with(least, "highs", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: (x["a"] <= x["b"]) & (F.col("upper") >= x["a"]))
    further = pairs.join(home.withColumnRenamed("tile", "home"), "uid").where("tile != home").join(told, "uid").where(within).select("uid", "tile")
    found = near.unionByName(searched(told, further, tiles, shape, k, same))
    order = Window.partitionBy("uid", "w").orderBy(F.desc("score"), "id", "label")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("uid", "w", "rank", "score", "id")


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, tile_rows: int = TILE, leaf_rows: int = LEAF,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors among ``rows_of`` a table.

    ``anchors`` is a condition on (id, label). The positives of an anchor are its best other rows of its label; the negatives of a
    positive the best rows of other labels that score ``low`` to ``high`` per cent of it (none where it scores below zero).
    """
    shape = Shape(rows)
    tiles = packed(rows, shape, tile_rows, leaf_rows)
    width = shape.width

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = [np.array([*v, *[0] * (width - len(v))], np.int32).tobytes() for v in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(q, pa.binary())], ["uid", "id", "label", "q"])

    own = cut(rows.where(anchors).distinct()).withColumn("uid", F.monotonically_increasing_id())
    asked = cut(own.select("uid", "id", "label", "v").mapInArrow(encoded, "uid long, id long, label long, q binary"))
    every = asked.withColumns({"lows": F.array(F.lit(LOWEST)), "highs": F.array(F.lit(HIGHEST))})
    like = cut(best(every, tiles, shape, positives, True).select("uid", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    bounded = like.where("positive_score >= 0").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("p", "positive_score"))).alias("x"))
    whole = lambda x: F.call_function("div", x, F.lit(100))
    windows = bounded.select(
        "uid", F.transform("x", lambda x: x["p"]).alias("ps"), F.transform("x", lambda x: whole(x["positive_score"] * low + 99)).alias("lows"),
        F.transform("x", lambda x: whole(x["positive_score"] * high)).alias("highs"),
    )
    found = best(asked.join(windows.drop("ps"), "uid"), tiles, shape, negatives, False)
    named = found.join(windows.select("uid", "ps"), "uid").select("uid", F.get("ps", F.col("w")).alias("p"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(like, ["uid", "p"]).join(asked.select("uid", F.col("id").alias("anchor_id")), "uid").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
