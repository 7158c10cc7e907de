"""Elias-Fano sequences, the n-gram trie, the quality network and decontamination against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import decontaminate, ngram_model, quality_net
from storyloom.llm.elias_fano import EliasFano, pack, unpack


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 10), (5, 5), (1000, 1 << 50), (20_000, 1 << 62), (5000, 6000), (3, 0)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top + 1, n).astype(np.uint64))
    arrays, facts = EliasFano.build(values, "x")
    code = EliasFano(*unpack(np.frombuffer(pack(arrays, **facts), np.uint8)), "x")
    assert (code.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, rng.integers(0, top + 9, 2000).astype(np.uint64)])
    wanted = {int(v): i for i, v in enumerate(values)}
    assert code.find(asked).tolist() == [wanted.get(int(v), -1) for v in asked]


@pytest.mark.parametrize("small", [False, True])
def test_trie_against_counts(spark, monkeypatch, small):
    if small:  # groups, runs and slices of a few tokens: the same results
        for name, value in (("GROUP", 7), ("RUN", 11), ("SLICE", 9), ("SHARD_BYTES", 300)):
            monkeypatch.setattr(ngram_model, name, value)
    rng = random.Random(2)
    words = ["the"] * 40 + [f"w{i}" for i in range(60)] + ["Été", "A"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(120)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokens = {i: [w for w in (t or "").encode().lower().split()] + [None] for i, t in enumerate(texts)}
    held = {i for i in tokens if crc32(str(i).encode()) % 10 == 0}
    one, two, three = Counter(), Counter(), Counter()
    for i, t in tokens.items():
        if i not in held:
            one.update(t)
            two.update(zip(["begin", *t], t, strict=False))
            three.update(zip(["begin", *t], t, t[1:], strict=False))
    three = Counter({k: n for k, n in three.items() if n > 1})
    begins = Counter()
    for (u, v, _), n in three.items():
        begins[u, v] += n
    assert len(three) > 50
    total, distinct = sum(one.values()), len(one)
    one["begin"] = one[None]
    share = lambda w: (one[w] + 0.1) / (total + 0.1 * (distinct + 1))
    for r in ngram_model.learn_and_score(df).collect():
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in held, len(t), sum(one[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10(share(w)) for w in t), abs=1e-9)
        wanted = 0.0
        for u, v, w in zip([None, "begin", *t], ["begin", *t], t, strict=False):
            p = (two[v, w] + 2 * share(w)) / (one[v] + 2)
            if v != "begin" and begins[u, v]:
                p = (three[u, v, w] + p) / (begins[u, v] + 1)
            wanted += math.log10(p)
        assert r["score"] == pytest.approx(wanted, abs=2 * len(t) / ngram_model.STEPS)


def test_probabilities_of_a_context_add_up():
    counts, context = np.array([3.0, 1.0, 0.0, 0.0]), 4.0
    share = np.log10(np.array([0.4, 0.3, 0.2, 0.1]))
    assert (10 ** ngram_model.smoothed(counts, context, share)).sum() == pytest.approx(1)


def test_frequent_contexts_are_cut_into_ranges():
    words = ngram_model.Words([0], ["x"], [100], 1000)
    bounds = ngram_model.pair_bounds(words, [(7, 500), (9, 3)], 10)
    inside = [b for b in bounds if 7 << 32 <= b < 8 << 32]
    assert len(inside) == 5 and bounds == sorted(set(bounds)) and bounds[0] == 0


def test_network_learns_signs_and_scores_in_slices(monkeypatch):
    rng = random.Random(3)
    clean = [" ".join(rng.choices(["ab", "cde", "fg"], k=rng.randrange(5, 300))).encode() for _ in range(120)]
    junk = [t.replace(b"e ", b"e### ") + b" ###" for t in clean]
    weights = quality_net.train(clean[:80] + junk[:80], np.array([1.0] * 80 + [0.0] * 80))
    network = quality_net.Network(weights)
    right = sum(network.score(t) >= 0.5 for t in clean[80:]) + sum(network.score(t) < 0.5 for t in junk[80:])
    assert right >= 76
    long = b"".join(clean + junk)
    whole = network.logit(long)
    monkeypatch.setattr(quality_net, "SLICE", 4 * quality_net.BLOCK)
    assert network.logit(long) == pytest.approx(whole, rel=1e-5) and 0 <= network.score(b"") <= 1
    # Chunks pool what their two blocks hold, as a plain convolution says.
    text = np.frombuffer(clean[0][:700], np.uint8)
    plain = weights["bias"] + sum(weights["filters"][j][np.r_[text, [0] * 3][j : j + len(text)]] for j in range(4))
    assert np.allclose(np.concatenate(list(network.blocks(clean[0][:700])))[0], plain[:256].max(axis=0), atol=1e-4)


def test_held_out_labels_are_not_learned_from(spark):
    ids = [i for i in range(400)]
    df = spark.createDataFrame([(i, "good words here" if i % 2 else "### bad ###") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality_net.classify(df, labels).collect()}
    assert {i for i, r in found.items() if r["held_out"]} == {i for i in ids if crc32(str(i).encode()) % 4 == 2}
    assert all(r["predicted"] == i % 2 for i, r in found.items())


def _plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) >= 128:
            word += c
        else:
            out += [word] if word else []
            word = ""
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", -1)
    rng = random.Random(4)
    vocabulary = ["a", "b", "É", "é", "c1", "D", "long"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 12, 15])))) for i in range(12)] + [(90, ""), (91, None)]
    texts = []
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(30))
        if rng.random() < 0.6:
            words[3:3] = (rng.choice(items)[1] or "").split()
        texts.append((rng.choice([", ", " ", "-"])).join(words))
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, texts[0]), (500, None)]
    found = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    counts = Counter(x.lower() for _, t in rows for x in _plain_words(t))
    ranked = [sorted({(counts[x.lower()], x.lower()) for x in _plain_words(t) if counts[x.lower()]}) for _, t in items]
    rarest = [(r[0][1], r[1][1]) for r in ranked if len(r) > 1]
    wanted = []
    for doc_id, text in rows:
        w, hit, hits = _plain_words(text), set(), set()
        for item, t in items:
            q = _plain_words(t)
            for s in range(max(len(q) - 9, 1)) if q else ():
                window = q[s : s + 10]
                for at in range(len(w) - len(window) + 1):
                    if w[at : at + len(window)] == window:
                        hits.add(str(item))
                        hit |= set(range(at, at + len(window)))
        low = [x.lower() for x in w]
        close = sum(any(abs(a - b) <= 16 for a, x in enumerate(low) if x == one for b, y in enumerate(low) if y == two) for one, two in rarest)
        wanted.append((doc_id, len(w), len(hit), len(hits), close))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["n_near"]) for r in found.collect()), key=key) == sorted(wanted, key=key)


def test_proximity_at_its_exact_distance(spark):
    docs = [(1, "rare x x x thing"), (2, "rare " + "x " * 60 + "thing"), (3, "thing y rare"), (4, "rare " + "x " * 15 + "thing"), (5, "rare " + "x " * 16 + "thing"), (None, "thing rare")]
    items = spark.createDataFrame([(7, "the rare and the thing")], "item_id long, text string")
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert {r["doc_id"]: r["n_near"] for r in found.collect()} == {1: 1, 2: 0, 3: 1, 4: 1, 5: 0, None: 1}


def test_long_labelled_texts_are_learned_from(spark):
    texts = [("good words here " if i % 2 else "### bad ### ") * 2000 for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert all(r["predicted"] == r["doc_id"] % 2 for r in quality_net.classify(df, labels).collect())
    long = "".join(chr(97 + k % 26) for k in range(50_000))
    cut = spark.createDataFrame([(long,), ("short",), (None,)], "text string").select(quality_net.sampled(F.col("text")).alias("t")).collect()
    size, part = quality_net.TRAIN_CHARS // 4, [k * (50_000 - quality_net.TRAIN_CHARS // 4) // 3 for k in range(4)]
    assert [r["t"] for r in cut] == ["".join(long[at : at + size] for at in part), "short", None]
