"""SentencePiece encoding and decoding with N-best segmentation.

The piece lattice of a text has an arc for every vocabulary piece that occurs in it, and byte pieces for
characters that are no piece. A forward Viterbi pass gives the two best scores of reaching each position; a backward
A* search from the end uses these scores as its heuristic. They are exact, so paths come out best first.

No piece of the vocabulary goes on over a blank that follows another character, nor over a line feed, so the
lattice falls apart into chunks there. Each chunk is searched on its own, short chunks met before are remembered (up
to a fixed number of bytes for each worker), and the N best paths of a text are the N cheapest sums of the chunks' losses.

A chunk of more than ``LONG`` characters is searched in packed arrays: no arc is kept, each pass reads the arcs anew, and
the A* queue holds N entries. That takes about 40 bytes for each character and 60 for each piece of a further path.

A piece of rank r has the score log(1 / (r + 2.7)), normalised over the vocabulary and held as a whole number
of millionths, so sums are exact and ties real.

Defined results: a null text is empty; an empty text has no pieces, score zero and one path; equal scores come
out in one fixed order; repeated rows each get a row; extra columns are ignored. Decoding gives back every text
exactly, the blank mark of the vocabulary and line ends included. An empty table gives no rows. Texts of any
length are encoded whole; what a chunk without blanks needs is in proportion to its length.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from storyloom.functions.slices import slices
from storyloom.llm.common import id_and_text, per_batch

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK, N_BEST = "▁", 4
MICRO = 1_000_000
#: Less than any score.
UNREACHED = -(1 << 60)
#: Bytes of remembered chunks, twice, and what an entry takes beside its text and value; longest chunk remembered.
REMEMBERED_BYTES, ENTRY_BYTES, LONGEST_REMEMBERED = 150_000_000, 210, 48
#: What stands before a remembered chunk's ids: score and loss, as numbers of ids' width.
HEAD = struct.Struct("<qd")
HEAD_IDS = HEAD.size // 4
#: Longest chunk whose lattice is held whole; what stands for a character's bytes in packed arrays of ids, and for no arc.
LONG, BYTES, NONE = 1 << 14, -1, -2
CHANGES = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("count", pa.int32()), ("ids", pa.list_(pa.int32()))])))
CHUNKS = re.compile(r" *[^ \n]+|\n| +")


def _shown(chunk: str) -> str:
    """A chunk as pieces spell it: blanks as marks, and real marks, which no piece has inside, as line feeds."""
    return chunk.replace(MARK, "\n").replace(" ", MARK)


class Pieces:
    """The vocabulary: ids and scores of pieces, and of bytes for all else."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        total = math.log(sum(1 / (r + 2.7) for r in range(len(plain))))
        self.by_text = {model.id_to_piece(i): (i, round(-MICRO * (math.log(r + 2.7) + total))) for r, i in enumerate(plain)}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.by_text):
            raise ValueError("pieces must not go on over a blank or a line feed")
        ends = {p: found for p, found in self.by_text.items()}
        nodes: dict[str, dict] = {"": {}}
        for p in sorted({p[:n] for p in ends for n in range(1, len(p) + 1)}, key=len):
            number, score = ends.get(p, (None, None))
            nodes[p] = {}
            nodes[p[:-1]][p[-1]] = (nodes[p], score, number)
        self.trie, self.longest, self.alone = nodes[""], max(map(len, ends)), {p for p in ends if len(p) == 1}
        self.length_of = {i: len(p) for p, (i, _) in ends.items()} | {BYTES: 1}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_score = min(score for _, score in self.by_text.values()) - 10 * MICRO
        self.bytes_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.bytes_of |= {i: p.replace(MARK, " ").encode() for p, (i, _) in self.by_text.items()}

    def lattice(self, chunk: str) -> tuple[list[tuple[int, int, int, int | None]], list[int]]:
        """(arcs, best): all arcs as (start, end, score, id), a null id for a character's bytes, and the best score of reaching each position."""
        shown = _shown(chunk)
        arcs = [(i, j, score, None if number == BYTES else number) for i in range(len(chunk)) for j, score, number in self.arcs_from(chunk, shown, i)]
        return arcs, self.two_best(chunk)[0]

    def two_best(self, chunk: str) -> tuple[list[int], list[int], list[int]]:
        """(best, second, came): for each position the scores of the best and the second best path to it, and the id of the last arc of the best one.

        An arc is a piece, or a character's bytes (``BYTES``) where no piece has just the character; of equal scores that of the first start stays.
        """
        shown, size = _shown(chunk), len(chunk)
        trie, longest, alone = self.trie, self.longest, self.alone
        best, second, came = [UNREACHED] * (size + 1), [UNREACHED] * (size + 1), [NONE] * (size + 1)
        best[0] = 0
        for i in range(size):
            here, other, node, j = best[i], second[i], trie, i
            for c in shown[i : i + longest]:
                step = node.get(c)
                if step is None:
                    break
                node, score, number = step
                j += 1
                if score is not None:
                    top, now = best[j], here + score
                    if now > top:
                        score += other
                        second[j] = top if top > score else score
                        best[j], came[j] = now, number
                    elif now > second[j]:
                        second[j] = now
            if shown[i] not in alone:
                j, score = i + 1, self.byte_score * len(chunk[i].encode("utf-8", "surrogatepass"))
                top, now = best[j], here + score
                if now > top:
                    second[j] = max(top, other + score)
                    best[j], came[j] = now, BYTES
                elif now > second[j]:
                    second[j] = now
        return best, second, came

    def arcs_from(self, chunk: str, shown: str, i: int) -> list[tuple[int, int, int]]:
        """(end, score, id) of the arcs from a position, ``BYTES`` for a character's bytes; as ``lattice`` has them."""
        found, node, j = [], self.trie, i
        for c in shown[i : i + self.longest]:
            step = node.get(c)
            if step is None:
                break
            node, score, number = step
            j += 1
            if score is not None:
                found.append((j, score, number))
        if not found or found[0][0] > i + 1:
            found.append((i + 1, self.byte_score * len(chunk[i].encode("utf-8", "surrogatepass")), BYTES))
        return found

    def forward(self, chunk: str) -> tuple[array, array]:
        """(best, came) in packed arrays: the forward Viterbi scores and, for each position, the id of the arc taken to it."""
        shown, size = _shown(chunk), len(chunk)
        best, came = array("q", [UNREACHED]) * (size + 1), array("i", [NONE]) * (size + 1)
        best[0] = 0
        for i in range(size):
            here = best[i]
            for j, score, number in self.arcs_from(chunk, shown, i):
                if here + score > best[j]:
                    best[j], came[j] = here + score, number
        return best, came

    def long_best_path(self, chunk: str) -> tuple[array, int, float]:
        """``best_path`` in packed arrays."""
        shown, size = _shown(chunk), len(chunk)
        best, came = self.forward(chunk)
        taken, at = array("i", [NONE]) * size, size
        while at:
            number = came[at]
            at -= self.length_of[number]
            taken[at] = number
        back, second = array("q", [UNREACHED]) * (size + 1), UNREACHED
        back[size] = 0
        for i in range(size - 1, -1, -1):
            own, before, top = taken[i], best[i], UNREACHED
            for j, score, number in self.arcs_from(chunk, shown, i):
                score += back[j]
                if score > top:
                    top = score
                if number != own and score + before > second:
                    second = score + before
            back[i] = top
        ids = array("i")
        for i, number in enumerate(taken):
            if number >= 0:
                ids.append(number)
            elif number == BYTES:
                ids.extend(self.ids_of(chunk, i, None))
        return ids, best[size], math.inf if second == UNREACHED else best[size] - second

    def ids_of(self, chunk: str, start: int, number: int | None) -> list[int]:
        """The ids of an arc."""
        return [number] if number is not None else [self.byte_ids[b] for b in chunk[start].encode("utf-8", "surrogatepass")]

    def best_path(self, chunk: str) -> tuple[list[int] | array, int, float]:
        """(ids, score, loss): the best path, and how much worse the second best is.

        The two best paths to a position end in an arc from one of the two best to an earlier one.
        """
        if len(chunk) > LONG:
            return self.long_best_path(chunk)
        best, second, came = self.two_best(chunk)
        at, ids, length_of = len(chunk), [], self.length_of
        while at:
            number = came[at]
            at -= length_of[number]
            if number >= 0:
                ids.append(number)
            else:
                ids += reversed(self.ids_of(chunk, at, None))
        ids.reverse()
        return ids, best[-1], math.inf if second[-1] == UNREACHED else best[-1] - second[-1]

    def n_best(self, chunk: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best (score, ids) of a chunk, best first.

        An entry of the queue stands for paths of its own, the best of which has exactly the entry's score, so entries
        beyond the n first ones can't come up.
        """
        shown, size = _shown(chunk), len(chunk)
        best = self.forward(chunk)[0] if size > LONG else self.two_best(chunk)[0]
        ranked: dict[int, list[tuple[int, int, int | str]]] = {}
        found: list[tuple[int, tuple[int, ...]]] = []
        heap: list[tuple] = []
        turn = 0

        def into(j: int) -> list[tuple[int, int, int | str]]:
            """(start, score, id or character) of the arcs to a position, best first."""
            arcs = ranked.get(j)
            if arcs is None:
                if len(ranked) > LONG:
                    ranked.clear()
                arcs = []
                for i in range(max(j - self.longest, 0), j):
                    piece = self.by_text.get(shown[i:j])
                    if piece:
                        arcs.append((i, piece[1], piece[0]))
                if not arcs or arcs[-1][0] < j - 1:
                    c = chunk[j - 1]
                    arcs.append((j - 1, self.byte_score * len(c.encode("utf-8", "surrogatepass")), c))
                arcs.sort(key=lambda arc: (-best[arc[0]] - arc[1], arc[0]))
                ranked[j] = arcs
            return arcs

        def push(j: int, rank: int, after: int, tail: tuple | None) -> None:
            nonlocal turn, heap
            arcs = into(j)
            if rank < len(arcs):
                i, s, _ = arcs[rank]
                turn += 1
                heapq.heappush(heap, (-(best[i] + s + after), i, turn, j, rank, after, tail))
                if len(heap) > 8 * n:
                    heap = heapq.nsmallest(n - len(found), heap)

        push(size, 0, 0, None)
        while heap and len(found) < n:
            cost, i, _, j, rank, after, tail = heapq.heappop(heap)
            _, s, number = into(j)[rank]
            link = (number, tail)
            push(j, rank + 1, after, tail)
            if i:
                push(i, 0, after + s, link)
            else:
                path: list[int] = []
                while link:
                    number, link = link
                    path += (number,) if isinstance(number, int) else self.ids_of(number, 0, None)
                found.append((-cost, tuple(path)))
        return found

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of some ids: the pieces' bytes, less the blank put in front."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


class Encoder(dict):
    """Remembered chunks: best score, loss of the second best path and ids, in one string of bytes, as that takes the least memory.

    When full, what was met lately becomes the older half and a chunk found there comes back.
    """

    def __init__(self, pieces: Pieces, n_best: int):
        super().__init__()
        self.pieces, self.n_best, self.older, self.held = pieces, n_best, {}, 0
        search = lambda chunk: pieces.n_best(chunk, n_best)
        remembered = lru_cache(maxsize=20_000)(search)
        self.paths = lambda chunk: (remembered if len(chunk) <= LONGEST_REMEMBERED else search)(chunk)

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            ids, score, loss = self.pieces.best_path(chunk)
            found = HEAD.pack(score, loss) + array("i", ids).tobytes()
        if len(chunk) <= LONGEST_REMEMBERED:
            if self.held >= REMEMBERED_BYTES:
                self.older, self.held = dict(self), 0
                self.clear()
            self.held += len(chunk) + len(found) + ENTRY_BYTES
            self[chunk] = found
        return found

    def encode(self, text: str) -> tuple[np.ndarray, list[int], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """(ids of the best path, scores of the N best, for each of these the changes to the best path).

        A change (start, count, ids) puts ids in the place of count ids of the best path.
        """
        if not text:
            return np.zeros(0, dtype="<i4"), [0], [[]]
        chunks = CHUNKS.findall(" " + text)
        found = list(map(self.__getitem__, chunks))
        packed, ends = np.frombuffer(b"".join(found), dtype="<i4"), np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
        heads = np.concatenate(([0], ends[:-1]))[:, None] + np.arange(HEAD_IDS)
        scored = packed[heads].view(np.dtype([("score", "<i8"), ("loss", "<f8")]))[:, 0]
        plain = np.ones(len(packed), bool)
        plain[heads] = False
        ids, best, total = packed[plain], scored["score"], int(scored["score"].sum())
        starts = heads[:, 0] - HEAD_IDS * np.arange(len(found))
        # Only the chunks with the least losses can take part in the N best; these are searched.
        losses = scored["loss"]
        keep = min(self.n_best - 1, len(found))
        nearest = sorted(np.argsort(losses, kind="stable")[:keep].tolist()) if keep else []
        options, spans = [], []
        for c in nearest:
            own, paths = tuple(array("i", found[c][HEAD.size :])), self.paths(chunks[c])
            if paths[0][1] != own:  # of equal scores another came first
                paths = [(int(best[c]), own), *(x for x in paths if x[1] != own)][: self.n_best]
            options.append(paths)
            spans.append((int(starts[c]), len(own)))
        scores, picks = [], []
        heap: list[tuple[int, tuple[int, ...]]] = [(0, (0,) * len(nearest))]
        seen = {heap[0][1]}
        while heap and len(scores) < self.n_best:
            loss, pick = heapq.heappop(heap)
            scores.append(total - loss)
            picks.append([(*span, paths[rank][1]) for span, paths, rank in zip(spans, options, pick, strict=True) if rank])
            for k, paths in enumerate(options):
                nxt = (*pick[:k], pick[k] + 1, *pick[k + 1 :])
                if nxt[k] < len(paths) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (loss + paths[pick[k]][0] - paths[nxt[k]][0], nxt))
        return ids, scores, picks


def changed(ids: list[int], changes: list[tuple[int, int, list[int]]]) -> list[int]:
    """The ids of a further path, from those of the best one and the (start, count, ids) where it differs."""
    out, at = [], 0
    for start, count, other in changes:
        out += [*ids[at:start], *other]
        at = start + count
    return [*out, *ids[at:]]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def encoder(path: str, n_best: int) -> Encoder:
    """One per worker process, so what a task remembers serves the next one."""
    return Encoder(pieces(path), n_best)


def encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = VOCABULARY, n_best: int = N_BEST
) -> DataFrame:
    """(doc_id, ids, scores, others, round_trip): the best path's ids, the N best scores in millionths, decoded == text.

    ``others`` has the second to N-th best path in the order of ``scores``, each as its changes to ``ids`` (``changed``).
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chunks = pieces(vocabulary_path), encoder(vocabulary_path, n_best)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, scores, others, same = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                found, ranked, picks = chunks.encode(text)
                ids.append(found)
                scores.append(ranked)
                others.append(picks[1:])
                same.append(known.decode(found.tolist()) == text)
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), type=pa.int32()))
            columns = [lists, pa.array(scores, type=pa.list_(pa.int64())), pa.array(others, type=CHANGES), pa.array(same)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "ids", "scores", "others", "round_trip"])

        yield from per_batch(run)(part for batch in batches for part in slices(batch))

    schema = "doc_id long, ids array<int>, scores array<long>, others array<array<struct<start: int, count: int, ids: array<int>>>>, round_trip boolean"
    return id_and_text(df, id_col, text_col).mapInArrow(apply, schema)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from ids; null ids give a null text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(vocabulary_path)
        for batch in batches:
            texts = [None if x.as_py() is None else known.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], ["doc_id", "text"])

    return df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{ids_col}` as array<int>) as ids").mapInArrow(
        apply, "doc_id long, text string"
    )
