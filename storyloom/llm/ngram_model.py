"""Language-model scoring with an Elias-Fano n-gram trie of order 3.

The trie has three levels, each a row of shards in the shared folder, memory-mapped by the tasks that read them.
Level 1 holds the sorted 64-bit hashes of the words and their counts; a word's id is its place. Level 2 holds,
for each context word that a shard covers, a monotone pointer into the ascending successor ids, and for each
successor its smoothed probability as a 16-bit code. Level 3 does the same for contexts of two words, and knows a
word by its place among the successors of the second one, a small number. A pair is looked up by the context's place,
its pointers, and a successor search between them; a triple by the number of its first pair and that place.

Smoothing: P(w | v) = (c(v, w) + K P(w)) / (c(v) + K) with P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)); a pair that
was never seen takes the same formula with no count. Triples take part from ``least`` occurrences on, a parameter of
``build`` (two by default, as those that occur once are most and say least; 1 keeps all): P(w | u, v) = (c(u, v, w) + K P(w | v)) / (C(u, v) + K), C the sum of the counts that take
part; a pair that begins none of them leaves P(w | v). So the probabilities of all words and of one unknown word add up
to 1 for each context.

Building: tasks count hashes (then pairs of ids) in bounded blocks, and send sorted, delta-coded and compressed
runs by range of the key, so what is shuffled is counts, not tokens. Ranges are cut by how many tokens the words
in them have, and the successors of a word with a large share are cut into several ranges: no task holds a hot
word or a hot pair. There are as many ranges as the corpus has times ``SHARD_BYTES`` of text, so what a task merges
doesn't grow with the corpus. Shards are written under names of their own for each attempt, and only those that a
completed task reports are used, so lost executors do no harm. The driver sees one line per shard.

Texts are split into words twice only: to count the words, and to store all tokens as ids and counts, in compressed
blocks of whole texts (a Parquet table in the shared folder). Pairs, triples and scores are read from these.

Defined results: a null text is empty and is one end token; a null id is in no fold, neither held out nor learned
from; with no training rows all counts are zero; repeated rows count each; an empty table gives no rows; extra
columns are ignored. Words are told apart by their 64-bit hashes: two words with one hash would count as one (with
a billion distinct words the chance that any two do is 3 %). There may be 2^32 distinct words at most. Long texts are
read in slices and blocks; what grows with a text are its compressed blocks, less than the text itself.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from storyloom.llm.common import id_and_text, shared_folder
from storyloom.llm.elias_fano import EliasFano, pack, unpack

FOLDS, HELD_OUT = 10, 0
ADD, STRENGTH, STRENGTH_3, LEAST = 0.1, 2.0, 1.0, 2
#: No word has a blank, so these stand for the end of a text; its beginning is a context only.
END = xxh64_intdigest(b" ")
GROUP, RUN, SLICE = 400_000, 4_000_000, 4 << 20
STEPS = 4096  # codes per power of ten
SPACE = b" \t\n\x0b\x0c\r"
TOP_WORDS = 16
TOKEN_COLUMNS = ["doc_ids", "sizes", "known", "base", "blocks"]
TOKENS = "doc_ids array<long>, sizes array<long>, known array<long>, base array<double>, blocks array<binary>"
#: Text for each range of words or pairs; bytes of shards that a worker holds where the shared folder can't be mapped.
SHARD_BYTES, HELD_BYTES = 32 << 20, 256 << 20


def is_training(doc_id: int | None) -> bool:
    return doc_id is not None and crc32(str(doc_id).encode()) % FOLDS != HELD_OUT


# --- tokens ---------------------------------------------------------------------------------------------------


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of a text of about ``SLICE`` bytes, cut at white space."""
    at = 0
    while len(text) - at > SLICE:
        cut = max(text.rfind(bytes([c]), at, at + SLICE) for c in SPACE)
        if cut <= at:  # one word longer than a slice: up to its end
            after = [x for x in (text.find(bytes([c]), at + SLICE) for c in SPACE) if x >= 0]
            cut = min(after, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_groups(texts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, hashes, begins) of the tokens of some texts, about ``GROUP`` at a time; an end token closes a text."""
    rows: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    begins: list[np.ndarray] = []
    size = 0
    for row, text in texts:
        first = True
        parts = list(_slices(text)) if len(text) > SLICE else [text]
        for k, part in enumerate(parts):
            found = [xxh64_intdigest(w) for w in part.lower().split()]
            if k == len(parts) - 1:
                found.append(END)
            if not found:
                continue
            h = np.array(found, dtype=np.uint64)
            b = np.zeros(len(h), dtype=bool)
            b[0], first = first, False
            rows.append(np.full(len(h), row, dtype=np.int32))
            hashes.append(h)
            begins.append(b)
            size += len(h)
            if size >= GROUP:
                yield np.concatenate(rows), np.concatenate(hashes), np.concatenate(begins)
                rows, hashes, begins, size = [], [], [], 0
    if size:
        yield np.concatenate(rows), np.concatenate(hashes), np.concatenate(begins)


# --- sorted runs of keys and counts ------------------------------------------------------------------------------


def _encode_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, bytes of equal weight together, and counts; compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    wide = counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(steps + wide, codec="zstd", asbytes=True)


def _decode_run(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(run[:8], "little")
    flat = np.frombuffer(pa.decompress(run[8:], decompressed_size=16 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    steps, counts = (np.ascontiguousarray(x.reshape(8, n).T).view("<u8")[:, 0] for x in (flat[: 8 * n], flat[8 * n :]))
    return np.cumsum(steps, dtype=np.uint64), counts


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts (one each by default)."""
    if counts is None:
        found, n = np.unique(keys, return_counts=True)
        return found, n.astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=int)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _runs(keys: Iterator[np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(shard, run) rows: counts of blocks of keys, cut at the lower bounds of the shards."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = _summed(np.concatenate(held))
        cuts = np.searchsorted(found, bounds[1:])
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(found)]
        used = np.flatnonzero(ends > starts)
        runs = [_encode_run(found[starts[k] : ends[k]], counts[starts[k] : ends[k]]) for k in used]
        return pa.RecordBatch.from_arrays([pa.array(used, type=pa.int32()), pa.array(runs, type=pa.binary())], ["shard", "run"])

    held, size = [], 0
    for block in keys:
        held.append(block)
        size += len(block)
        if size >= RUN:
            yield emit(held)
            held, size = [], 0
    if size:
        yield emit(held)


# --- shards in the shared folder -----------------------------------------------------------------------------------


def _write(folder: str, name: str, block: bytes) -> str:
    """A new file below the shared folder; its path."""
    place, base = fs.FileSystem.from_uri(folder)
    place.create_dir(base, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}"
    with place.open_output_stream(f"{base}/{file}") as out:
        out.write(block)
    return f"{folder}/{file}"


class _Shards:
    """Shards opened by this worker: mapped where the folder is a mounted one, else read and held up to a number of bytes."""

    def __init__(self) -> None:
        self.open: dict[str, tuple[dict[str, np.ndarray], dict[str, int], dict[str, EliasFano], int]] = {}
        self.held = 0

    def get(self, path: str) -> tuple[dict[str, np.ndarray], dict[str, int], dict[str, EliasFano], int]:
        found = self.open.pop(path, None)
        if found is None:
            place, base = fs.FileSystem.from_uri(path)
            if isinstance(place, fs.LocalFileSystem):
                block, size = np.memmap(base, dtype=np.uint8, mode="r"), 0
            else:
                with place.open_input_file(base) as source:
                    block = np.frombuffer(source.readall(), dtype=np.uint8)
                size = len(block)
            found = (*unpack(block), {}, size)
            self.held += size
        self.open[path] = found  # the last one in order
        while (self.held > HELD_BYTES or len(self.open) > 4096) and len(self.open) > 1:
            self.held -= self.open.pop(next(iter(self.open)))[3]
        return found


_SHARDS = _Shards()


def _shard(path: str) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    return _SHARDS.get(path)[:2]


def _sequence(path: str, name: str) -> EliasFano:
    arrays, facts, made, _ = _SHARDS.get(path)
    if name not in made:
        made[name] = EliasFano(arrays, facts, name)
    return made[name]


class Words:
    """Level 1: ids and counts of words by hash. A shard covers hashes from its bound to the next."""

    def __init__(self, bounds: list[int], paths: list[str | None], sizes: list[int], total: int):
        self.bounds, self.paths = np.array(bounds, dtype=np.uint64), paths
        self.offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.total, self.distinct = total, int(self.offsets[-1])
        self.unknown = math.log10(ADD / (total + ADD * (self.distinct + 1)))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of ascending hashes; -1 and 0 for unknown ones."""
        ids, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        cuts = [0, *np.searchsorted(hashes, self.bounds[1:]).tolist(), len(hashes)]
        for k, path in enumerate(self.paths):
            s, e = cuts[k], cuts[k + 1]
            if path and e > s:
                place = _sequence(path, "hash").find(hashes[s:e])
                known = place >= 0
                ids[s:e] = np.where(known, place + self.offsets[k], -1)
                counts[s:e][known] = _shard(path)[0]["count"][place[known]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ascending known ids; the id after the last is the beginning of a text: as many as ends."""
        out = np.zeros(len(ids), dtype=np.int64)
        cuts = np.searchsorted(ids, self.offsets).tolist()
        for k, path in enumerate(self.paths):
            s, e = cuts[k], cuts[k + 1]
            if path and e > s:
                out[s:e] = _shard(path)[0]["count"][ids[s:e] - self.offsets[k]]
        if cuts[-1] < len(ids):
            out[cuts[-1] :] = self.find(np.array([END], dtype=np.uint64))[1][0]
        return out

    def log_share(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADD) / (self.total + ADD * (self.distinct + 1)))


def _ids(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(hashes, return_inverse=True)
    ids, counts = words.find(found)
    return ids[inverse], counts[inverse]


class _Contexts:
    """Ids of the words before, group by group; the beginning has the id after the last word's."""

    def __init__(self, begin: int):
        self.begin, self.last = begin, -1

    def of(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        before = np.where(begins, self.begin, np.r_[self.last, ids[:-1]])
        self.last = ids[-1]
        return before


class Pairs:
    """Level 2 by ranges of (context id, word id); a pair's number is its place among all."""

    def __init__(self, bounds: list[int], paths: list[str | None], sizes: list[int]):
        self.bounds, self.paths = np.array(bounds, dtype=np.uint64), paths
        self.offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        # Shards that go on with the context of an earlier one: that context, and the number of its first pair.
        whole = {b: k for k, b in enumerate(bounds)}
        self.goes_on = {k: (b >> 32, int(self.offsets[whole[b >> 32 << 32]])) for k, b in enumerate(bounds) if b & 0xFFFFFFFF}

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, numbers, places) of ascending pairs (context << 32 | word).

        A code is -1 where a pair was never seen; its number, and its place among the context's successors, are -1
        where it was seen less than ``least`` times.
        """
        codes, numbers, places = (np.full(len(pairs), -1, dtype=np.int64) for _ in range(3))
        cuts = [0, *np.searchsorted(pairs, self.bounds[1:]).tolist(), len(pairs)]
        for k, path in enumerate(self.paths):
            s, e = cuts[k], cuts[k + 1]
            if not path or e <= s:
                continue
            context, word = pairs[s:e] >> np.uint64(32), pairs[s:e] & np.uint64(0xFFFFFFFF)
            found, first, _ = _successors(path, context, word)
            at = np.flatnonzero(found >= 0)
            place, arrays = found[at], _shard(path)[0]
            codes[s + at] = arrays["code"][place]
            often = (arrays["often"][place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            at, place = at[often], place[often]
            start = first[at] + self.offsets[k]
            if k in self.goes_on:
                start = np.where(context[at] == np.uint64(self.goes_on[k][0]), self.goes_on[k][1], start)
            numbers[s + at] = place + self.offsets[k]
            places[s + at] = numbers[s + at] - start
        return codes, numbers, places

    def successors(self, word: int) -> int:
        """How many successors a context word has."""
        total = 0
        first, last = (int(np.searchsorted(self.bounds, np.uint64(x << 32), side="right")) - 1 for x in (word, word + 1))
        for path in filter(None, self.paths[first : last + 1]):
            place = _sequence(path, "context").find(np.array([word], dtype=np.uint64))
            if place[0] >= 0:
                ends = _sequence(path, "pointer").get(np.array([place[0], place[0] + 1])).astype(np.int64)
                total += int(ends[1] - ends[0])
        return total


def _successors(path: str, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the successors, of each context's first one, of the contexts) in a shard; -1 for what it lacks."""
    starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    place = _sequence(path, "context").find(context[starts])
    pointers, span = _sequence(path, "pointer"), np.uint64(_shard(path)[1]["span"])
    known = np.maximum(place, 0)
    first, last = pointers.get(known).astype(np.int64), pointers.get(known + 1).astype(np.int64)
    last = np.where(place >= 0, last, first)
    repeat = np.diff(np.r_[starts, len(context)])
    first, last, known, place = (np.repeat(x, repeat) for x in (first, last, known, place))
    last = np.where(word < span, last, first)
    return _sequence(path, "successor").find(known.astype(np.uint64) * span + np.minimum(word, span), first, last), first, place


class Triples:
    """Level 3 by ranges of (number of the first two words' pair, place of the third); ``bits`` are the place's.

    Pairs whose triples lie in several shards are few: ``cut`` has the sum of their counts.
    """

    def __init__(self, bits: int, bounds: list[int], paths: list[str | None], cut: dict[int, float]):
        self.bits, self.bounds, self.paths, self.cut = bits, np.array(bounds, dtype=np.uint64), paths, cut

    def key(self, pair: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Keys of triples; a place of -1 has one that no triple has."""
        none = np.uint64((1 << self.bits) - 1)
        if len(place) and int(place.max()) >= int(none):
            raise ValueError("more pairs and successors than fit in 64 bits")
        return pair.astype(np.uint64) << np.uint64(self.bits) | np.where(place >= 0, place.astype(np.uint64), none)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own, back) of ascending keys, as log10: what a triple's count gives (-inf for none), and what P(w | v) is weighed by."""
        own, back = np.full(len(keys), -np.inf), np.zeros(len(keys))
        cuts = [0, *np.searchsorted(keys, self.bounds[1:]).tolist(), len(keys)]
        for k, path in enumerate(self.paths):
            s, e = cuts[k], cuts[k + 1]
            if not path or e <= s:
                continue
            pair = keys[s:e] >> np.uint64(self.bits)
            found, _, at = _successors(path, pair, keys[s:e] & np.uint64((1 << self.bits) - 1))
            arrays, known, hit = _shard(path)[0], np.flatnonzero(at >= 0), np.flatnonzero(found >= 0)
            back[s + known] = arrays["back"][at[known]] / -STEPS
            own[s + hit] = arrays["code"][found[hit]] / -STEPS
        for pair, total in self.cut.items():
            s, e = np.searchsorted(keys, np.array([pair, pair + 1], dtype=np.uint64) << np.uint64(self.bits))
            whole = math.log10(STRENGTH_3 / (total + STRENGTH_3))
            own[s:e] += whole - back[s:e]  # the shard's own sum is taken out
            back[s:e] = whole
        return own, back


class Model:
    """The trie."""

    def __init__(self, words: Words, pairs: Pairs, triples: Triples | None = None):
        self.words, self.pairs, self.triples = words, pairs, triples


def smoothed(pair_counts: np.ndarray, context_counts: np.ndarray, log_share: np.ndarray) -> np.ndarray:
    """log10 P(word | context)."""
    return np.log10((pair_counts + STRENGTH * 10.0**log_share) / (context_counts + STRENGTH))


# --- building ------------------------------------------------------------------------------------------------------


def _training_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for row, (doc_id, text) in enumerate(zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True)):
        if is_training(doc_id.as_py()):
            yield row, text.as_py() or b""


def _build_words(docs: DataFrame, folder: str, parts: int) -> tuple[Words, list[tuple[int, int]]]:
    """Level 1, and the (id, count) of its most frequent words."""
    bounds = [-(-(k << 64) // parts) for k in range(parts)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = (h for batch in batches for _, h, _ in token_groups(_training_texts(batch)))
        yield from _runs(hashes, np.array(bounds, dtype=np.uint64))

    def store(rows: pa.Table) -> pa.Table:
        keys, counts = _merged_runs(rows)
        arrays, facts = EliasFano.build(keys, "hash")
        small = counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64)
        shard = rows.column("shard")[0].as_py()
        path = _write(folder, f"words-{shard}", pack(arrays | {"count": small}, **facts))
        top = np.argsort(counts)[-TOP_WORDS:]
        return pa.table({
            "shard": pa.array([shard], type=pa.int32()), "path": [path], "n": [len(keys)], "total": [int(counts.sum())],
            "top": pa.array([top.tolist()], type=pa.list_(pa.int64())), "top_n": pa.array([counts[top].astype(np.int64).tolist()], type=pa.list_(pa.int64())),
        })

    counted = docs.mapInArrow(count, "shard int, run binary").groupBy("shard")
    lines = counted.applyInArrow(store, "shard int, path string, n long, total long, top array<long>, top_n array<long>").collect()
    paths, sizes = [None] * parts, [0] * parts
    for x in lines:
        paths[x["shard"]], sizes[x["shard"]] = x["path"], x["n"]
    words = Words(bounds, paths, sizes, sum(x["total"] for x in lines))
    if words.distinct >= 1 << 32:
        raise ValueError("more than 2^32 distinct words")
    frequent = [(int(words.offsets[x["shard"]]) + at, n) for x in lines for at, n in zip(x["top"], x["top_n"], strict=True)]
    return words, frequent


def pair_bounds(words: Words, frequent: list[tuple[int, int]], parts: int) -> list[int]:
    """Lower bounds of the ranges of pairs: those of the word shards, and finer ones around frequent contexts."""
    bounds = {0, words.distinct << 32, *(int(x) << 32 for x in words.offsets[:-1])}
    share = max(words.total / parts, 1.0)
    for word, n in frequent:
        if n > share / 4:
            cuts = math.ceil(n / share)
            bounds |= {(word << 32) + (k << 32) // cuts for k in range(cuts)} | {(word + 1) << 32}
    return sorted(bounds)


def triple_bounds(pairs: Pairs, bits: int, cuts: list[int], hot: list[tuple[int, int, int]]) -> list[int]:
    """Lower bounds of the ranges of triples: those of the pairs' shards, at some pairs, and within pairs (number, second word, ranges) that need more."""
    bounds = {0, *(int(n) << bits for n in pairs.offsets[:-1]), *(n << bits for n in cuts)}
    for number, word, parts in hot:
        size = pairs.successors(word)
        bounds |= {(number << bits) + k * size // parts for k in range(parts)} | {(number + 1) << bits}
    return sorted(bounds)


def _encoded(context: np.ndarray, successor: np.ndarray, span: int) -> tuple[dict[str, np.ndarray], dict[str, int], np.ndarray, np.ndarray]:
    """(arrays, facts) of a shard's contexts, pointers and successors; where each context begins, and each entry's context."""
    starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    place = np.cumsum(np.r_[0, context[1:] != context[:-1]])
    made = [
        EliasFano.build(context[starts], "context"), EliasFano.build(np.r_[starts, len(context)], "pointer"),
        EliasFano.build(place.astype(np.uint64) * np.uint64(span) + successor, "successor"),
    ]
    return {k: v for a, _ in made for k, v in a.items()}, {k: v for _, f in made for k, v in f.items()} | {"span": span}, starts, place


def _code(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-STEPS * logs), 0, 65535).astype(np.uint16)


def _merged_runs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    runs = [_decode_run(x.as_py()) for x in rows.column("run")]
    return _summed(np.concatenate([k for k, _ in runs]), np.concatenate([c for _, c in runs]))


# --- tokens as ids ---------------------------------------------------------------------------------------------------


def _encode_tokens(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ids (-1 for unknown words) and counts of tokens in order, bytes of equal weight together; compressed."""
    width = max((int(counts.max()).bit_length() + 7) // 8, 1)
    parts = [ids.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :4], counts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]]
    return bytes([width]) + len(ids).to_bytes(8, "little") + pa.compress(b"".join(x.T.tobytes() for x in parts), codec="zstd", asbytes=True)


def _decode_tokens(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, n = block[0], int.from_bytes(block[1:9], "little")
    flat = np.frombuffer(pa.decompress(block[9:], decompressed_size=(4 + width) * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(-1, n)
    wide = np.zeros((2, n, 8), dtype=np.uint8)
    wide[0, :, :4], wide[1, :, :width] = flat[:4].T, flat[4:].T
    ids, counts = wide.view("<i8")[:, :, 0]
    return np.where(ids == 0xFFFFFFFF, -1, ids), counts


def _token_rows(words: Words, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A row for about ``GROUP`` tokens of whole texts: blocks of tokens, and of each text its id, size and base columns."""
    n, start, blocks = batch.num_rows, 0, []
    sizes, known, base = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    texts = ((row, x.as_py() or b"") for row, x in enumerate(batch.column(1).cast(pa.binary())))
    for rows, hashes, _ in token_groups(texts):
        ids, counts = _ids(words, hashes)
        sizes += np.bincount(rows, minlength=n)
        known += np.bincount(rows[counts > 0], minlength=n)
        base += np.bincount(rows, weights=words.log_share(counts), minlength=n)
        blocks.append(_encode_tokens(ids, counts))
        if hashes[-1] == END:
            stop = int(rows[-1]) + 1
            columns = [batch.column(0).slice(start, stop - start), *(pa.array(x[start:stop]) for x in (sizes, known, base)), pa.array(blocks, type=pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], type=pa.int32()), x) for x in columns], TOKEN_COLUMNS)
            start, blocks = stop, []


def tokens(docs: DataFrame, words: Words) -> DataFrame:
    """The texts of (doc_id, text) as ids and counts, in rows of many texts (``TOKENS``)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _token_rows(words, batch)

    return docs.mapInArrow(apply, TOKENS)


def _blocks(sizes: np.ndarray, blocks: pa.Array, begin: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, counts, begins, contexts) of the tokens of a row of ``tokens``, block by block; rows are places in ``sizes``."""
    contexts, ends, at = _Contexts(begin), np.cumsum(sizes), 0
    starts = ends - sizes
    for block in blocks:
        ids, counts = _decode_tokens(block.as_py())
        first, last = np.searchsorted(starts, [at, at + len(ids)])
        begins = np.zeros(len(ids), dtype=bool)
        begins[starts[first:last] - at] = True
        rows = first - 1 + np.cumsum(begins)
        at += len(ids)
        yield rows, ids, counts, begins, contexts.of(ids, begins)


def _training_blocks(words: Words, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, begins, contexts) of the tokens of the training rows of (doc_ids, sizes, blocks)."""
    for batch in batches:
        for doc_ids, sizes, blocks in zip(*batch.columns, strict=True):
            training = np.array([is_training(x) for x in doc_ids.as_py()])
            for rows, ids, _, begins, before in _blocks(sizes.values.to_numpy(), blocks.values, words.distinct):
                kept = training[rows]
                if kept.any():
                    yield ids[kept], begins[kept], before[kept]


class _Numbers:
    """Codes of the pairs of tokens, and keys of their triples, group by group."""

    def __init__(self, pairs: Pairs):
        self.pairs, self.last = pairs, -1

    def of(self, ids: np.ndarray, before: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, number of the pair before, place) of each token; -1 for none."""
        codes, numbers, places = (np.full(len(ids), -1, dtype=np.int64) for _ in range(3))
        seen = np.flatnonzero((ids >= 0) & (before >= 0))
        keys, inverse = np.unique(before[seen].astype(np.uint64) << np.uint64(32) | ids[seen].astype(np.uint64), return_inverse=True)
        for out, found in zip((codes, numbers, places), self.pairs.find(keys), strict=True):
            out[seen] = found[inverse]
        earlier = np.where(begins, -1, np.r_[self.last, numbers[:-1]])
        self.last = numbers[-1]
        return codes, earlier, places


def build(docs: DataFrame, least: int = LEAST) -> Model:
    """The model of the training rows of (doc_id, text); triples that occur less than ``least`` times leave P(w | v)."""
    return _build(docs, least)[0]


def _build(docs: DataFrame, least: int) -> tuple[Model, DataFrame]:
    """The model, and the stored ``tokens`` of all rows."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/ngrams-{uuid.uuid4().hex}"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-size // SHARD_BYTES), spark.sparkContext.defaultParallelism)
    words, frequent = _build_words(docs, folder, parts)
    tokens(docs, words).write.parquet(f"{folder}/tokens")
    stored = spark.read.schema(TOKENS).parquet(f"{folder}/tokens")
    learned = stored.select("doc_ids", "sizes", "blocks")
    pairs, cuts, hot = _build_pairs(learned, folder, words, pair_bounds(words, frequent, parts), max(words.total / parts, 1.0), least)
    bits = 64 - max(int(pairs.offsets[-1]).bit_length(), 1)
    triples = _build_triples(learned, folder, words, pairs, bits, triple_bounds(pairs, bits, cuts, hot), least)
    return Model(words, pairs, triples), stored


def _build_pairs(learned: DataFrame, folder: str, words: Words, bounds: list[int], share: float, least: int) -> tuple[Pairs, list[int], list[tuple[int, int, int]]]:
    """Level 2; the numbers of pairs at which level 3 is cut, and (number, second word, ranges) of pairs that it cuts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64) for ids, _, before in _training_blocks(words, batches))
        yield from _runs(keys, np.array(bounds, dtype=np.uint64))

    def store(rows: pa.Table) -> pa.Table:
        keys, counts = _merged_runs(rows)
        context, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        arrays, facts, starts, _ = _encoded(context, word, words.distinct)
        known, inverse = np.unique(word.astype(np.int64), return_inverse=True)
        log_share = words.log_share(words.counts(known))[inverse]
        around = np.repeat(words.counts(context[starts].astype(np.int64)), np.diff(np.r_[starts, len(keys)]))
        arrays["code"] = _code(smoothed(counts.astype(np.float64), around, log_share))
        arrays["often"] = np.packbits(counts >= least, bitorder="little")
        weight = np.where(counts >= least, counts, 0)
        summed = np.cumsum(weight)
        cuts = np.unique(np.searchsorted(summed, np.arange(share, float(summed[-1]), share)))
        hot = np.flatnonzero(weight > share)
        shard, numbers = rows.column("shard")[0].as_py(), lambda x: pa.array([np.asarray(x).astype(np.int64).tolist()], type=pa.list_(pa.int64()))
        return pa.table({
            "shard": pa.array([shard], type=pa.int32()), "path": [_write(folder, f"pairs-{shard}", pack(arrays, **facts))], "n": [len(keys)], "cuts": numbers(cuts),
            "hot": numbers(hot), "hot_word": numbers(word[hot]), "hot_parts": numbers(np.ceil(weight[hot] / share)),
        })

    schema = "shard int, path string, n long, cuts array<long>, hot array<long>, hot_word array<long>, hot_parts array<long>"
    lines = learned.mapInArrow(count, "shard int, run binary").groupBy("shard").applyInArrow(store, schema).collect()
    paths, sizes = [None] * len(bounds), [0] * len(bounds)
    for x in lines:
        paths[x["shard"]], sizes[x["shard"]] = x["path"], x["n"]
    pairs = Pairs(bounds, paths, sizes)
    offset = lambda x: int(pairs.offsets[x["shard"]])
    hot = [(offset(x) + n, word, parts) for x in lines for n, word, parts in zip(x["hot"], x["hot_word"], x["hot_parts"], strict=True)]
    return pairs, [offset(x) + n for x in lines for n in x["cuts"]], hot


def _build_triples(learned: DataFrame, folder: str, words: Words, pairs: Pairs, bits: int, bounds: list[int], least: int) -> Triples:
    """Level 3."""
    empty = Triples(bits, bounds, [], {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[np.ndarray]:
            numbers = _Numbers(pairs)
            for ids, begins, before in _training_blocks(words, batches):
                _, earlier, place = numbers.of(ids, before, begins)
                both = (earlier >= 0) & (place >= 0)
                if both.any():
                    yield empty.key(earlier[both], place[both])

        yield from _runs(keys(), np.array(bounds, dtype=np.uint64))

    def store(rows: pa.Table) -> pa.Table:
        keys, counts = _merged_runs(rows)
        keys, counts = keys[counts >= least], counts[counts >= least].astype(np.float64)
        shard, path, ends, sums = rows.column("shard")[0].as_py(), "", [], []
        if len(keys):
            pair, successor = keys >> np.uint64(bits), keys & np.uint64((1 << bits) - 1)
            arrays, facts, starts, place = _encoded(pair, successor, int(successor.max()) + 1)
            total = np.add.reduceat(counts, starts)
            arrays["code"] = _code(np.log10(counts / (total + STRENGTH_3)[place]))
            arrays["back"] = _code(np.log10(STRENGTH_3 / (total + STRENGTH_3)))
            path = _write(folder, f"triples-{shard}", pack(arrays, **facts))
            ends, sums = pair[starts][[0, -1]].astype(np.int64).tolist(), total[[0, -1]].tolist()
        return pa.table({
            "shard": pa.array([shard], type=pa.int32()), "path": [path], "ends": pa.array([ends], type=pa.list_(pa.int64())), "sums": pa.array([sums], type=pa.list_(pa.float64())),
        })

    lines = learned.mapInArrow(count, "shard int, run binary").groupBy("shard").applyInArrow(store, "shard int, path string, ends array<long>, sums array<double>").collect()
    paths: list[str | None] = [None] * len(bounds)
    inside = {b >> bits for b in bounds if b & ((1 << bits) - 1)}
    cut: dict[int, float] = {}
    for x in lines:
        paths[x["shard"]] = x["path"] or None
        for pair, total in dict(zip(x["ends"], x["sums"], strict=True)).items():
            if pair in inside:
                cut[pair] = cut.get(pair, 0.0) + total
    return Triples(bits, bounds, paths, cut)


# --- scoring -------------------------------------------------------------------------------------------------------


def _scores(model: Model, sizes: np.ndarray, blocks: pa.Array, begin_count: int) -> np.ndarray:
    """Scores of the texts of a row of ``tokens``."""
    words, n, score = model.words, len(sizes), np.zeros(len(sizes))
    numbers, last_count = _Numbers(model.pairs), 0
    for rows, ids, counts, begins, before in _blocks(sizes, blocks, words.distinct):
        around = np.where(begins, begin_count, np.r_[last_count, counts[:-1]])
        last_count = counts[-1]
        logs = smoothed(np.zeros(len(ids)), around, words.log_share(counts))
        codes, earlier, place = numbers.of(ids, before, begins)
        logs[codes >= 0] = codes[codes >= 0] / -STEPS
        third = np.flatnonzero(earlier >= 0)
        keys, inverse = np.unique(model.triples.key(earlier[third], place[third]), return_inverse=True)
        own, back = (x[inverse] for x in model.triples.find(keys))
        logs[third] = np.log10(10.0**own + 10.0 ** (back + logs[third]))
        score += np.bincount(rows, weights=logs, minlength=n)
    return score


def score_tokens(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every text of ``tokens``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_count = int(model.words.find(np.array([END], dtype=np.uint64))[1][0])
        for batch in batches:
            for *columns, blocks in zip(*batch.columns, strict=True):
                found = pa.array(_scores(model, columns[1].values.to_numpy(), blocks.values, begin_count))
                names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
                yield pa.RecordBatch.from_arrays([*(x.values for x in columns), found], names)

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    return rows.select(*TOKEN_COLUMNS).mapInArrow(apply, schema)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row, also of rows that the model was not built from."""
    return score_tokens(tokens(id_and_text(df, id_col, text_col), model.words), model)


def learn_and_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    model, stored = _build(id_and_text(df, id_col, text_col), least)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT
    return score_tokens(stored, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.words.total).cast("long").alias("train_tokens"), "base_score", "score",
    )
