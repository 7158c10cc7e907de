"""Token counts by linear longest-match over a vocabulary automaton.

A word is cut greedily: always the longest vocabulary piece that fits, the first piece from the word-initial
entries and the others from the continuation entries. The automaton is the trie of both with, for each node,
a failure link (the node to go on from once pieces are popped) and the number of pieces popped on the way.
Reading a word moves along trie edges or failure links; every letter is read once and every link crossed pops
a piece, so the time is linear in the word and no piece is ever built: only counts are added.

Defined results: a null text is empty and has no words; a word that can't be cut is one unknown token; repeated
rows each get a row; an empty table gives no rows; extra columns are ignored. Words of any length are handled whole. Counts of words met
before are remembered by a task, up to a fixed number of words; that changes no result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from storyloom.llm.common import id_and_text, per_batch

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The mark of word-initial pieces in the vocabulary file.
MARK = "▁"
REMEMBERED, LONGEST_REMEMBERED = 400_000, 64


class Automaton:
    """Trie over characters with failure links and popped-token counts.

    ``step[node]`` maps a character to a child; node 0 is the start of a word, node 1 of a continuation.
    ``fail[node]`` is None where no piece is a prefix of what the node stands for.
    """

    def __init__(self, initial: Iterable[str], continuation: Iterable[str]):
        self.step: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, initial), (1, continuation)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.step[at]:
                        self.step[at][c] = len(self.step)
                        self.step.append({})
                        ends.append(False)
                    at = self.step[at][c]
                ends[at] = ends[at] or at > 1
        self.fail: list[int | None] = [None] * len(self.step)
        self.popped = [0] * len(self.step)
        queue = deque((0, 1))
        while queue:
            parent = queue.popleft()
            for c, node in self.step[parent].items():
                if ends[node]:  # the whole node is the longest piece
                    self.fail[node], self.popped[node] = 1, 1
                else:
                    z, count = self.fail[parent], self.popped[parent]
                    while z is not None and c not in self.step[z]:
                        count += self.popped[z]
                        z = self.fail[z]
                    if z is not None:
                        self.fail[node], self.popped[node] = self.step[z][c], count
                queue.append(node)

    def count(self, word: str) -> int:
        """Pieces of a word by greedy longest match; 0 if it can't be cut."""
        at, count = 0, 0
        step, fail, popped = self.step, self.fail, self.popped
        for c in word:
            while c not in step[at]:
                count += popped[at]
                at = fail[at]
                if at is None:
                    return 0
            at = step[at][c]
        while at != 1:  # pop what is left
            count += popped[at]
            at = fail[at]
            if at is None:
                return 0
        return count


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(word-initial, continuation) pieces of a piece-vocabulary file; control and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in plain]
    initial = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return initial, [p for p in pieces if MARK not in p]


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(*vocabulary(path))


class _Counts(dict):
    """Tokens of a word, computed when first asked for; negative for the one token of an unknown word."""

    def __init__(self, machine: Automaton):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: bytes) -> int:
        count = self.machine.count(word.decode()) or -1
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = count
        return count


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every row; words are runs without ASCII white space."""

    def apply(batches):  # noqa: ANN001, ANN202
        known = _Counts(automaton(vocabulary_path))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, n_tokens, n_unknown = [], [], []
            for value in batch.column(1).cast(pa.binary()):
                words = (value.as_py() or b"").split()
                counts = list(map(known.__getitem__, words))
                unknown = counts.count(-1)
                n_words.append(len(words))
                n_tokens.append(sum(counts) + 2 * unknown)
                n_unknown.append(unknown)
            columns = [pa.array(x, type=pa.int64()) for x in (n_words, n_tokens, n_unknown)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_tokens", "n_unknown"])

        yield from per_batch(run)(batches)

    return id_and_text(df, id_col, text_col).mapInArrow(apply, "doc_id long, n_words long, n_tokens long, n_unknown long")
