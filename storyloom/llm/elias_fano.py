"""Elias-Fano coded monotone sequences in packed, memory-mapped arrays, searched with numpy for many keys at once."""

from __future__ import annotations

import json

import numpy as np

ONE = np.uint64(1)


def pack(arrays: dict[str, np.ndarray], **facts: int) -> bytes:
    """Arrays and whole numbers as one block: header, then the arrays, each at a multiple of eight bytes."""
    places, at = {}, 0
    for name, a in arrays.items():
        places[name] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // 8) * 8
    head = json.dumps({"arrays": places, "facts": {k: int(v) for k, v in facts.items()}}).encode()
    head += b" " * (-len(head) % 8)
    out = bytearray(len(head).to_bytes(8, "little") + head)
    for a in arrays.values():
        out += a.tobytes() + bytes(-a.nbytes % 8)
    return bytes(out)


def unpack(block: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """Views into a block (an array of bytes, for example a memory map)."""
    size = int.from_bytes(block[:8].tobytes(), "little")
    head = json.loads(block[8 : 8 + size].tobytes())
    base = 8 + size
    arrays = {
        name: block[base + at : base + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in head["arrays"].items()
    }
    return arrays, head["facts"]


def _merged(words: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """An array of ``size`` words with ``values`` or-ed in at ascending places."""
    out = np.zeros(size, dtype=np.uint64)
    if len(words):
        starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        out[words[starts]] |= np.bitwise_or.reduceat(values, starts)
    return out


class EliasFano:
    """A sequence of ascending whole numbers (uint64): low bits packed, high bits in unary."""

    def __init__(self, arrays: dict[str, np.ndarray], facts: dict[str, int], name: str):
        self.low, self.high, self.ones = (arrays[f"{name}.{part}"] for part in ("low", "high", "ones"))
        self.n, self.width, self.base, self.top = (facts[f"{name}.{part}"] for part in ("n", "width", "base", "top"))

    @staticmethod
    def build(values: np.ndarray, name: str) -> tuple[dict[str, np.ndarray], dict[str, int]]:
        """(arrays, facts) for ``pack``."""
        n = len(values)
        base = int(values[0]) if n else 0
        relative = values.astype(np.uint64) - np.uint64(base)
        top = int(relative[-1]) if n else 0
        width = max((top // max(n, 1)).bit_length() - 1, 0)
        at = np.arange(n, dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        size = (n * width >> 6) + 2
        low = np.zeros(size, dtype=np.uint64)
        if width:
            bits = relative & np.uint64((1 << width) - 1)
            low = _merged(word, bits << shift, size)
            over = shift + np.uint64(width) > np.uint64(64)
            low |= _merged(word[over] + 1, bits[over] >> (np.uint64(64) - shift[over]), size)
        place = (relative >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = _merged(place >> 6, ONE << (place & 63).astype(np.uint64), ((n + (top >> width) + 1) >> 6) + 1)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)].astype(np.uint32)
        facts = {f"{name}.n": n, f"{name}.width": width, f"{name}.base": base, f"{name}.top": top}
        return {f"{name}.low": low, f"{name}.high": high, f"{name}.ones": ones}, facts

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th one or zero, from 0, in the high bits."""
        if zeros:
            before = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
            word = np.searchsorted(before, k, side="right") - 1
            bits, rest = ~self.high[word], k - before[word]
        else:
            word = np.searchsorted(self.ones, k.astype(np.uint32), side="right") - 1
            bits, rest = self.high[word].copy(), k - self.ones[word].astype(np.int64)
        place = word.astype(np.int64) * 64
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & np.uint64((1 << step) - 1)).astype(np.int64)
            on = rest >= count
            rest -= np.where(on, count, 0)
            bits = np.where(on, bits >> np.uint64(step), bits)
            place += np.where(on, step, 0)
        return place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift | (self.low[word + 1] << ONE) << (np.uint64(63) - shift)
        return value & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at some places."""
        i = i.astype(np.int64)
        high = (self._select(i, zeros=False) - i).astype(np.uint64)
        return (high << np.uint64(self.width) | self._low(i)) + np.uint64(self.base)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Place of each x, -1 where absent; only from ``first`` up to, without, ``last`` if these are given."""
        out = np.full(len(x), -1, dtype=np.int64)
        relative = x - np.uint64(self.base)
        inside = np.flatnonzero((x >= np.uint64(self.base)) & (relative <= np.uint64(self.top))) if self.n else np.zeros(0, dtype=int)
        if not len(inside):
            return out
        relative = relative[inside]
        high = (relative >> np.uint64(self.width)).astype(np.int64)
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), zeros=True) - high + 1, 0)
        end = self._select(high, zeros=True) - high
        if first is not None:
            start, end = np.maximum(start, first[inside]), np.minimum(end, last[inside])
        low = relative & np.uint64((1 << self.width) - 1)
        stop = end.copy()
        todo = np.flatnonzero(start < end)
        while len(todo):
            middle = (start[todo] + end[todo]) >> 1
            less = self._low(middle) < low[todo]
            start[todo] = np.where(less, middle + 1, start[todo])
            end[todo] = np.where(less, end[todo], middle)
            todo = todo[start[todo] < end[todo]]
        hit = start < stop
        hit[hit] = self._low(start[hit]) == low[hit]
        out[inside[hit]] = start[hit]
        return out
