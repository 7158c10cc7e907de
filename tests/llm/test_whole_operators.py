"""Operators on generated rows against plain versions of the whole result: secrets, token counts, the network, pieces."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re

import numpy as np
import pytest

from storyloom.llm import pieces, quality_net, secrets, wordpiece
from tests.llm.test_secret_forms import FORMS
from tests.llm.test_text_ops import _greedy

RNG = random.Random(12)
WORDS = ["the", "of", "Ünïcode", "naïve", "x" * 30, "pass", "a.b", "Ĳ", "漢字", "secret", "12345", "don't"]


def _said(k):
    return " ".join(RNG.choices(WORDS, k=k))


def test_scan_of_generated_rows(spark):
    """Base spans by their patterns; each planted form adds its kind at its place, and nothing else adds any."""
    rows, planted = [], {}
    for i in range(300):
        text = _said(RNG.randrange(20))
        if i % 3 == 0:
            text += RNG.choice([" password: 'abcdefg'", " API_KEY=abc", " AKIA" + "A1" * 9, " token = " + "0f" * 14, " passwd:xyz123 secret=qwerty1"])
        if i % 4 == 0:
            form = RNG.choice(sorted(FORMS))
            planted[i] = (FORMS[form][0], len(text) + 1, len(text) + 1 + len(FORMS[form][1]))
            text = f"{text} {FORMS[form][1]} end"
        rows.append((i, text))
    rows += [(1000, None), (1001, "")]
    found = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, text in rows:
        text, base = text or "", []
        base += [(m.start(), 0, m.end(), "assign") for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        told = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(base))
        r = found[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(b[3] == k for b in base) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        added = [x.split(":") for x in r["spans"].split(",") if x and x.split(":")[0] in ("pem", "der", "ssh", "token")]
        assert bool(added) == (i in planted)
        for kind, start, end in added:
            assert planted[i][1] <= int(start) < int(end) <= planted[i][2]
        assert i not in planted or planted[i][0] in [k for k, _, _ in added]
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))


def test_token_counts_with_the_vocabulary_are_greedy_cuts(spark):
    initial, more = map(set, wordpiece.vocabulary(wordpiece.VOCABULARY))
    rows = [(i, _said(RNG.randrange(40)) + RNG.choice(["", " \x0c", "\n\n", " �\U0001f600"])) for i in range(120)] + [(900, None), (901, " ")]
    for r in wordpiece.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = re.findall(r"[^\x20\x09-\x0d]+", dict(rows)[r["doc_id"]] or "")
        counts = [_greedy(w, initial, more) for w in words]
        assert (r["n_words"], r["n_unknown"], r["n_tokens"]) == (len(words), counts.count(0), sum(c or 1 for c in counts))


def test_scores_are_the_plain_networks(spark):
    rng = np.random.default_rng(4)
    weights = {
        "filters": rng.normal(size=(4, 256, quality_net.FILTERS)), "bias": rng.normal(size=quality_net.FILTERS), "out": rng.normal(size=2 * quality_net.FILTERS + 1), "shift": np.array([0.3]),
    }
    texts = [_said(RNG.randrange(400)) for _ in range(30)] + ["", "a", "x" * 256, "y" * 257, "z" * 513]
    found = {r["doc_id"]: r["score"] for r in quality_net.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights).collect()}
    for i, text in enumerate(texts):
        octets = np.frombuffer(text.encode() or b"\0", np.uint8)
        padded = np.r_[octets, [0] * 3]
        answers = weights["bias"] + sum(weights["filters"][j][padded[j : j + len(octets)]] for j in range(4))
        blocks = [answers[at : at + 256].max(axis=0) for at in range(0, len(octets), 256)]
        chunks = np.maximum([np.maximum(a, b) for a, b in zip(blocks, blocks[1:], strict=False)] or blocks, 0)
        logit = chunks.max(axis=0) @ weights["out"][: quality_net.FILTERS] + chunks.mean(axis=0) @ weights["out"][quality_net.FILTERS : -1] + weights["out"][-1] + 0.3
        assert found[i] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-4)


def test_long_chunks_are_not_remembered():
    encoder = pieces.Encoder(pieces.pieces(pieces.VOCABULARY), 4)
    long = "ab" * 3000
    ids, scores, picks = encoder.encode(long)
    assert len(scores) == len(picks) == 4 and encoder.pieces.decode(ids.tolist()) == long
    assert all(len(chunk) <= pieces.LONGEST_REMEMBERED for chunk in encoder) and encoder.held < 10_000


def test_long_hostile_texts_are_scanned_in_one_pass():
    import time

    began = time.process_time()
    url = base64.urlsafe_b64encode(json.dumps({"alg": "none"}).encode()).decode().rstrip("=")
    for part in ("eyJ", "eyJhbGciOi", f"{url}.", "token=", "AKIA", "0f ", "MII", "-----BEGIN ", "password:'"):
        secrets.find(part * (400_000 // len(part)))
    assert time.process_time() - began < 30
