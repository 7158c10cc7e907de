"""SimHash near-duplicates by Golay-code fuzzy hashing.

1. ``fingerprints``: a 64-bit SimHash of each whole text (lower-cased A-Z, word shingles, XXH64 seed 42).
2. ``distinct``: copies fall together on their fingerprint before anything is compared.
3. ``fuzzy_keys``: a fingerprint is cut into segments of 22, 21 and 21 bits. Four differing bits leave either
   one segment untouched, and then another with at most two errors; or one error in each of two segments, so
   that an untouched half is left in both, and at most two in the third. A segment with at most two errors is
   found by the numbers of the Golay codewords near it. So each key is exact bits beside a codeword number,
   33 bits at least, and any two fingerprints within four bits share one.
4. ``links``: equal keys meet in one partition, sorted; each run of a key is verified and gives the edges of a
   spanning forest, not all its pairs. A run longer than ``RUN_LIMIT`` is set aside and compared in pairs of
   blocks, so no task holds an unbounded key and no pair is lost.
5. connected components of the links; the id is the smallest doc_id reachable.

With a ``similarity``, texts whose sets of five-word shingles have that Jaccard similarity are linked too, whatever
their fingerprints (``similar_links``): at 0.8 fingerprints differ in about 10 bits. MinHash bands give candidates
(a pair at 0.8 shares none of the bands with probability 3e-5), the shingle sets themselves decide.

Defined results: null and wordless texts have fingerprint zero and are linked like any other; repeated rows
each get a row; a null doc_id never names a component (a component of null ids only has a null id); an empty
table gives no rows; other columns of the input are ignored (``keep_first`` keeps them). A text of fewer words than a shingle is hashed as
its whole word sequence. Long texts are hashed in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from storyloom.llm.common import cut, id_and_text, join_counted, per_batch
from storyloom.llm.components import components
from storyloom.llm.golay import codeword_keys

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: (first bit, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Shingles of the Jaccard similarity; bands and MinHashes of each.
SET_SHINGLE, BANDS, BAND_ROWS = 5, 20, 4
#: Texts of one band key that are compared in one group; more go in pairs of blocks of half as many.
SET_LIMIT = 1024
BLOCK = 1 << 15
SMALL_RUN, RUN_LIMIT = 8, 4096
#: Fingerprints whose keys one task makes.
FINGERPRINTS = 50_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is set if it is set in over half the shingles' hashes."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = list(zip(starts, ends[shingle - 1 :], strict=False)) or [(0, len(line))]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(spans), BLOCK):
        part = [xxh64_intdigest(line[s:e], SEED) for s, e in spans[at : at + BLOCK]]
        octets = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(spans), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, text_key) of every row; fp is the fingerprint's 64 bits as a long, text_key the text's hash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary())
        fp = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in texts), dtype=np.uint64, count=len(texts))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_key"])

    rows = id_and_text(df, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(per_batch(run), "doc_id long, fp long, text_key long")


def _keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, fingerprints) of all fuzzy keys of some fingerprints (uint64)."""
    parts = [(fp >> np.uint64(at)) & np.uint64((1 << width) - 1) for at, width in SEGMENTS]
    halves = [(p & np.uint64(0x3FF), p >> np.uint64(10)) for p in parts]
    near = [codeword_keys(p) for p in parts]
    keys, owners, tag = [], [], 0
    for z in range(3):
        x, y = (i for i in range(3) if i != z)
        numbers, valid = near[z]
        rows = np.broadcast_to(fp[:, None], valid.shape)[valid]
        exact = [parts[x], parts[y]] + [a << np.uint64(11) | b for a in halves[x] for b in halves[y]]
        for e in exact:
            key = np.uint64(tag << 36) | e[:, None] << np.uint64(12) | numbers
            keys.append(key[valid])
            owners.append(rows)
            tag += 1
    return np.concatenate(keys), np.concatenate(owners)


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): about 96 keys for each fingerprint of ``fps``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fp), 4096):
                key, owner = _keys_of(fp[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(owner.view(np.int64))], ["key", "fp"])

    return fps.select("fp").mapInArrow(apply, "key long, fp long")


def _forest(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what lies within ``max_bits`` of each other, directly or over others."""
    a, b, rest = [], [], fp
    while len(rest):
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            near = np.zeros(len(rest), dtype=bool)
            for at in range(0, len(frontier), 256):
                part = frontier[at : at + 256]
                near |= (np.bitwise_count(part[:, None] ^ rest[None, :]) <= max_bits).any(axis=0)
            frontier, rest = rest[near], rest[~near]
            a.append(np.full(len(frontier), root))
            b.append(frontier)
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate([*a, empty]), np.concatenate([*b, empty])


def _link_runs(max_bits: int, run_limit: int):
    """mapInArrow over rows sorted by key: (a, b, null) for links, (fp, fp, key) for rows of too long runs."""

    def rows(a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
        marks = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), marks], ["a", "b", "key"])

    def whole_runs(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = np.repeat(sizes <= SMALL_RUN, sizes)
        found_a, found_b = [], []
        for lag in range(1, min(SMALL_RUN, len(key))):
            hit = (key[lag:] == key[:-lag]) & small[lag:]
            at = np.flatnonzero(hit)
            at = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= max_bits]
            found_a.append(fp[at])
            found_b.append(fp[at + lag])
        for s, n in zip(starts[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN], strict=True):
            if n > run_limit:
                yield rows(fp[s : s + n], fp[s : s + n], key[s : s + n])
            else:
                a, b = _forest(fp[s : s + n], max_bits)
                found_a.append(a)
                found_b.append(b)
        if found_a:
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
            yield rows(pairs[0].copy(), pairs[1].copy())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, aside = np.zeros(0, np.uint64), np.zeros(0, np.uint64), None
        for batch in batches:
            more_key, more_fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if aside is not None:  # the key whose first rows were set aside goes on
                n = int(np.searchsorted(more_key.view(np.int64), np.int64(aside), side="right"))
                yield rows(more_fp[:n], more_fp[:n], more_key[:n])
                more_key, more_fp = more_key[n:], more_fp[n:]
                if not len(more_key):
                    continue
                aside = None
            key, fp = np.r_[key, more_key], np.r_[fp, more_fp]
            if not len(key):
                continue
            last = int(np.searchsorted(key.view(np.int64), key[-1:].view(np.int64)[0]))
            if last:
                yield from whole_runs(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
            if len(key) > run_limit:
                aside = key[:1].view(np.int64)[0]
                yield rows(fp, fp, key)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from whole_runs(key, fp)

    return apply


def links(fps: DataFrame, max_bits: int = MAX_BITS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """(a, b): edges whose components are those of all fingerprints within ``max_bits`` of each other."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys find pairs of up to {MAX_BITS} differing bits")
    # About 96 keys come from one fingerprint, so these are dealt out first.
    dealt = fps.repartition(max(-(-fps.count() // FINGERPRINTS), fps.sparkSession.sparkContext.defaultParallelism))
    sorted_keys = fuzzy_keys(dealt).repartition("key").sortWithinPartitions("key")
    found = cut(sorted_keys.mapInArrow(_link_runs(max_bits, run_limit), "a long, b long, key long"))
    aside = found.where("key is not null").select("key", F.col("a").alias("fp"))
    counted = cut(aside.groupBy("key").agg(F.count("*").alias("n")))
    blocks = counted.select("key", "n", F.ceil(F.col("n") / (run_limit // 2)).cast("int").alias("blocks"))
    own = join_counted(aside, blocks, "key", counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    )

    def group(rows: pa.Table) -> pa.Table:
        a, b = _forest(rows.column("fp").to_numpy().view(np.uint64), max_bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return found.where("key is null").select("a", "b").unionByName(paired.groupBy("key", "i", "j").applyInArrow(group, "a long, b long"))


def shingle_set(text: bytes) -> np.ndarray:
    """The hashes of a text's distinct five-word shingles, sorted; of all its words if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = list(zip(starts, ends[SET_SHINGLE - 1 :], strict=False)) or [(0, len(line))]
    return np.unique(np.fromiter((xxh64_intdigest(line[s:e], SEED) for s, e in spans), dtype=np.uint64, count=len(spans)))


_MULTIPLIERS, _MASKS = np.random.default_rng(SEED).integers(0, 1 << 64, size=(2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
_MULTIPLIERS = _MULTIPLIERS | np.uint64(1)


def band_keys(shingles: np.ndarray) -> list[int]:
    """One key for each band of a set's MinHashes; an empty set has none."""
    if not len(shingles):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, ((shingles[None, at : at + 512] ^ _MASKS) * _MULTIPLIERS).min(axis=1))
    rows = least.astype("<u8").reshape(BANDS, BAND_ROWS)
    return np.array([xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], dtype=np.uint64).view(np.int64).tolist()


def sets_alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that connect what has the similarity, directly or over others."""
    edges, rest, frontier = [], list(range(len(sets))), []
    while rest:
        if not frontier:
            frontier = [rest.pop(0)]
            continue
        one = frontier.pop()
        sizes = np.array([len(sets[i]) for i in rest])
        them = np.concatenate([sets[i] for i in rest])
        at = np.minimum(np.searchsorted(sets[one], them), len(sets[one]) - 1)
        common = np.add.reduceat((sets[one][at] == them).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
        near = common >= similarity * (sizes + len(sets[one]) - common)
        found = [i for i, hit in zip(rest, near, strict=True) if hit]
        rest = [i for i, hit in zip(rest, near, strict=True) if not hit]
        edges += [(one, i) for i in found]
        frontier += found
    return edges


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, fp, text_key, bands) of every row; equal texts have one key."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
        fp = np.fromiter((fingerprint(x, shingle) for x in texts), dtype=np.uint64, count=len(texts))
        bands = pa.array([band_keys(shingle_set(x)) for x in texts], type=pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2), bands], ["doc_id", "fp", "text_key", "bands"])

    rows = id_and_text(df, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(per_batch(run), "doc_id long, fp long, text_key long, bands array<long>")


def similar_links(df: DataFrame, found: DataFrame, similarity: float, text_col: str = "text", limit: int = SET_LIMIT) -> DataFrame:
    """(a, b): fingerprints of texts of ``df`` whose shingle sets have the similarity; ``found`` is its ``sketches``."""
    one = found.groupBy("text_key").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    bands = cut(one.select("text_key", "fp", F.explode("bands").alias("key")))
    # Bands with the same texts are compared once.
    runs = bands.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("text_key")).alias("who")).where("n > 1")
    runs = cut(runs.groupBy("n", "who").agg(F.min("key").alias("key")))
    members = cut(join_counted(bands, runs.select("key", "n", F.col("n").alias("size")), "key", bands.count()).withColumnRenamed("size", "n"))
    texts = df.select(F.col(text_col).cast("string").alias("text")).select(F.xxhash64("text").alias("text_key"), "text")
    texts = texts.groupBy("text_key").agg(F.first("text").alias("text"))

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x.as_py() or b"").view(np.int64) for x in batch.column(1).cast(pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, type=pa.list_(pa.int64()))], ["text_key", "shingles"])

    wanted = texts.join(members.select("text_key").distinct(), "text_key", "left_semi").select("text_key", "text")
    sets = wanted.mapInArrow(per_batch(sets_of), "text_key long, shingles array<long>")
    blocks = F.when(F.col("n") > limit, F.ceil(F.col("n") / (limit // 2))).otherwise(1).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "text_key"
    )
    by = ["key", "i", "j"]
    rows = paired.join(sets, "text_key").select(*by, "fp", "shingles").repartition(*by).sortWithinPartitions(*by)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fps, held = None, [], []

        def edges() -> pa.RecordBatch:
            pairs = [(fps[x], fps[y]) for x, y in sets_alike(held, similarity) if fps[x] != fps[y]]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], type=pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            names = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            offsets = batch.column(4).offsets.to_numpy()
            values = batch.column(4).values.to_numpy().view(np.uint64)
            for n, (*name, fp) in enumerate(names):
                if name != group:
                    if len(held) > 1:
                        yield edges()
                    group, fps, held = name, [], []
                fps.append(fp)
                held.append(values[offsets[n] : offsets[n + 1]].copy())
        if len(held) > 1:
            yield edges()

    return rows.mapInArrow(apply, "a long, b long")


def _rooted(df: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """Stored rows of the documents (doc_id, fp, text_key) and of the distinct fingerprints (fp, first_id, n, root)."""
    if similarity is None:
        docs = cut(fingerprints(df, id_col, text_col, shingle))
    else:
        docs = cut(sketches(df, id_col, text_col, shingle))
    fps = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    edges = links(fps, max_bits)
    if similarity is not None:
        edges = edges.unionByName(similar_links(df, docs, similarity, text_col))
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    return docs, cut(fps.join(roots, "fp", "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root")))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, similarity: float | None = None
) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    Joins go by counts: a fingerprint that many rows share, or a component of many fingerprints, is broadcast.
    """
    docs, rooted = _rooted(df, id_col, text_col, shingle, max_bits, similarity)
    names = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    named = join_counted(rooted.select("root", "fp", F.col("n").alias("rows")), names, "root", rooted.count())
    named = cut(named.select("fp", F.col("rows").alias("n"), "component_id"))
    return join_counted(docs, named, "fp", docs.count()).select("doc_id", "fp", "component_id")


def keep_first(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, similarity: float | None = None
) -> DataFrame:
    """One row of each group of near-duplicates; rows with a null id all stay.

    It is the row with the smallest id, of rows with one id that with the smallest fingerprint, then hash of the
    text; of rows with one id and text that with the first values, as JSON. Rows with one id whose texts are no
    near-duplicates stay.
    """
    docs, rooted = _rooted(df, id_col, text_col, shingle, max_bits, similarity)
    total = docs.count()
    of_id, of_text, times = "id", "text", "times"
    known = docs.where(F.col("doc_id").isNotNull())
    same = known.groupBy("doc_id", "fp", "text_key").agg(F.count("*").alias("rows"))
    same = join_counted(same, rooted.select("fp", "root", "n"), "fp", total)
    least = same.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "text_key", "rows")).alias("first"))
    chosen = cut(least.select(F.col("first.doc_id").alias(of_id), F.col("first.text_key").alias(of_text), F.col("first.rows").alias("n")))
    # Rows under names of their own, so that no column of the input can clash.
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(whole, F.col(f"`{id_col}`").cast("long").alias(of_id), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias(of_text))
    found = join_counted(rows, chosen.withColumn(times, F.col("n")), [of_id, of_text], total)
    kept = found.where(F.col(times) == 1).select("row.*")
    if chosen.where("n > 1").limit(1).count():  # rows that come more than once are summed to one
        again = found.where(F.col(times) > 1).groupBy(of_id, of_text)
        kept = kept.unionByName(again.agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
    return kept.unionByName(rows.where(F.col(of_id).isNull()).select("row.*"))
