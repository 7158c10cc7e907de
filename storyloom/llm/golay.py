"""The binary [23, 12, 7] Golay code: every 23-bit word lies within three bits of exactly one codeword.

``codeword_keys`` decodes a word and all words one bit away from it and returns the message numbers (0..4095)
of the codewords found. Two words that differ in at most two bits have a word between them, at most one bit
from each, so they always share a number.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, MESSAGE = 23, 12
CHECK = LENGTH - MESSAGE
#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def syndrome(word: int) -> int:
    """Remainder of a word by the generator; zero for codewords."""
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the upper 12 bits, error patterns by syndrome, how many patterns).

    A syndrome whose lightest pattern has three bits has five patterns of four bits beside it: the codewords
    that a one-bit change of the word decodes to. The others have the one pattern.
    """
    upper = np.array([syndrome(x << CHECK) for x in range(1 << MESSAGE)], dtype=np.uint16)
    ones = [syndrome(1 << i) for i in range(LENGTH)]
    patterns: list[list[int]] = [[] for _ in range(1 << CHECK)]
    for weight in range(4):
        for bits in combinations(range(LENGTH), weight):
            s = 0
            for i in bits:
                s ^= ones[i]
            patterns[s].append(sum(1 << i for i in bits))
    heavy = {s for s, found in enumerate(patterns) if found[0].bit_count() == 3}
    for bits in combinations(range(LENGTH), 4):
        s = ones[bits[0]] ^ ones[bits[1]] ^ ones[bits[2]] ^ ones[bits[3]]
        if s in heavy:
            patterns[s].append(sum(1 << i for i in bits))
    count = np.array([len(found) for found in patterns], dtype=np.int64)
    table = np.zeros((1 << CHECK, int(count.max())), dtype=np.uint32)
    for s, found in enumerate(patterns):
        table[s, : len(found)] = found
    return upper, table, count


def codeword_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, valid), both of shape (len(words), 6): the message numbers near each 23-bit word."""
    upper, table, count = tables()
    words = words.astype(np.uint32)
    s = upper[words >> CHECK] ^ (words & ((1 << CHECK) - 1)).astype(np.uint16)
    numbers = ((words[:, None] ^ table[s]) >> CHECK).astype(np.uint64)
    return numbers, np.arange(table.shape[1]) < count[s][:, None]
