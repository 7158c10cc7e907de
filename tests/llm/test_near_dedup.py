"""The near-dedup stage against brute force over five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline
from storyloom.llm import simhash
from tests.llm.test_simhash import plain_fingerprint


def _shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def _texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randrange(60, 300))
        texts.append(" ".join(base))
        for rate in (0.01, 0.018, 0.022, 0.03):
            texts.append(" ".join(rng.choice(words) if rng.random() < rate else w for w in base))
    return texts


def test_near_copies_of_more_than_four_bits_are_dropped(spark):
    texts = _texts()
    sets, prints = [_shingles(t) for t in texts], [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    wide = [(i, j) for i, j in pairs if (prints[i] ^ prints[j]).bit_count() > 4]
    assert len(wide) > 20
    near = pairs + [(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = list(range(len(texts)))
    for _ in texts:
        before = list(root)
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == {i for i in range(len(texts)) if root[i] == i}
    docs = simhash.sketches(df, "doc_id", "text", simhash.SHINGLE)
    small = simhash.similar_links(df, docs, 0.8, limit=4).distinct().collect()  # the same by blocks
    linked = {i: i for i in prints}

    def top(x):
        while linked[x] != x:
            x = linked[x]
        return x

    for r in small:
        linked[top(r["a"] % (1 << 64))] = top(r["b"] % (1 << 64))
    assert all(top(prints[i]) == top(prints[j]) for i, j in pairs)
