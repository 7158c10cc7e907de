"""Fingerprints and components against plain versions."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from storyloom.llm import golay, simhash
from storyloom.llm.components import components


def plain_fingerprint(text: str) -> int:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in folded + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAÉb \t\n\x0b\x1c\xa0", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_words_two_bits_apart_share_a_codeword():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 23, 20_000).astype(np.uint32)
    bit = lambda: np.uint32(1) << rng.integers(0, 23, len(w)).astype(np.uint32)
    (a, a_ok), (b, b_ok) = golay.codeword_keys(w), golay.codeword_keys(w ^ bit() ^ bit())
    assert ((a[:, :, None] == b[:, None, :]) & a_ok[:, :, None] & b_ok[:, None, :]).any((1, 2)).all()


def test_four_bits_apart_share_a_key():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
    for some in range(0, len(x), 500):
        (kx, ox), (ky, oy) = simhash._keys_of(x[some : some + 500]), simhash._keys_of(y[some : some + 500])
        of = lambda k, o: {v: set(k[o == v].tolist()) for v in np.unique(o)}
        a, b = of(kx, ox), of(ky, oy)
        assert all(a[p] & b[q] for p, q in zip(x[some : some + 500], y[some : some + 500], strict=True))


def _roots(fps, edges):
    parent = {int(x): int(x) for x in fps}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in parent}


def test_links_have_all_components_also_in_blocks(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 62, 30).astype(np.uint64)
    fps = set(seeds.tolist())
    for s in seeds.tolist():  # chains and clouds around each seed, one of them large
        for _ in range(400 if s == int(seeds[0]) else 8):
            v = s
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                v ^= 1 << int(b)
            fps.add(v)
    fps = sorted(v - (1 << 64) if v >= 1 << 63 else v for v in fps)
    u = np.array(fps, dtype=np.int64).view(np.uint64)
    near = [(int(a), int(b)) for i, a in enumerate(fps) for b in np.array(fps)[i + 1 :][np.bitwise_count(u[i] ^ u[i + 1 :]) <= 4]]
    wanted = _roots(fps, near)
    df = spark.createDataFrame([(v,) for v in fps], "fp long")
    for limit in (simhash.RUN_LIMIT, 16):
        found = [(r["a"], r["b"]) for r in simhash.links(df, run_limit=limit).collect()]
        assert _roots(fps, found) == wanted
    roots = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
    assert roots == {v: r for v, r in wanted.items() if v in roots} and set(roots) == {v for e in near for v in e}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 5), (7, 3)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
