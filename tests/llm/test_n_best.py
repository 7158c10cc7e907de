"""The N best segmentations of encode(), against all segmentations of a text."""

from __future__ import annotations

import random
import tracemalloc

from storyloom.llm import pieces

TEXTS = ["the cat", "é\n a", "a  b\x07", "there", "aa aa", "", None, "漢 in", "x"]


def _score(vocabulary, ids):
    by_id = dict(vocabulary.by_text.values())
    return sum(by_id.get(i, vocabulary.byte_score) for i in ids)


def _all_paths(vocabulary, chunk):
    into = [[] for _ in range(len(chunk) + 1)]
    for i, j, s, number in vocabulary.lattice(chunk)[0]:
        into[j].append((i, s, vocabulary.ids_of(chunk, i, number)))
    ways = [[(0, ())]]
    for j in range(1, len(chunk) + 1):
        ways.append([(w + s, (*p, *ids)) for i, s, ids in into[j] for w, p in ways[i]])
    return ways[-1]


def test_all_n_segmentations_come_back(spark):
    vocabulary = pieces.pieces(pieces.VOCABULARY)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pieces.encode(df).collect():
        text = TEXTS[r["doc_id"]] or ""
        paths = [tuple(r["ids"]), *(tuple(pieces.changed(r["ids"], x)) for x in r["others"])]
        assert len(paths) == len(r["scores"]) == len(set(paths))
        assert all(vocabulary.decode(list(p)) == text for p in paths)
        every = _all_paths(vocabulary, " " + text) if text else [(0, ())]
        assert r["scores"] == sorted((s for s, _ in every), reverse=True)[:4]
        assert all((score, p) in every for score, p in zip(r["scores"], paths, strict=True))
        if text:
            assert [_score(vocabulary, p) for p in paths] == r["scores"]


def test_of_equal_scores_no_path_comes_twice():
    encoder = pieces.Encoder(pieces.pieces(pieces.VOCABULARY), 4)
    real = encoder.pieces.n_best
    encoder.paths = lambda chunk: [x for x in (real(chunk, 4)[1], *real(chunk, 4)) if x][:2]  # the best one second
    ids, _, picks = encoder.encode("there")
    paths = [tuple(pieces.changed(ids.tolist(), x)) for x in picks]
    assert paths[0] == tuple(ids.tolist()) and len(set(paths)) == len(paths)


def test_long_chunks_have_the_paths_of_short_ones(monkeypatch):
    vocabulary, rng = pieces.pieces(pieces.VOCABULARY), random.Random(5)
    chunks = ["".join(rng.choices(letters, k=rng.randint(1, 120))) for letters in ("ab", "thern", "0123456789abcdef", "漢é\x07▁a") for _ in range(15)]
    short = [(vocabulary.best_path(c), vocabulary.n_best(c, 4)) for c in chunks]
    monkeypatch.setattr(pieces, "LONG", 0)
    for c, ((ids, *rest), paths) in zip(chunks, short, strict=True):
        found, *other = vocabulary.best_path(c)
        assert (list(found), other) == (ids, rest) and vocabulary.n_best(c, 4) == paths


def test_a_long_chunk_takes_bounded_memory():
    vocabulary = pieces.pieces(pieces.VOCABULARY)
    text = "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=40_000))
    tracemalloc.start()
    ids, scores, picks = pieces.Encoder(vocabulary, 4).encode(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 * len(text)
    assert len(scores) == 4 and vocabulary.decode(ids.tolist()) == text
    assert all(vocabulary.decode(pieces.changed(ids.tolist(), x)) == text for x in picks)


def test_one_pass_gives_the_best_path_and_its_lead(monkeypatch):
    """The best path and how far the second one is behind, without a list of all arcs."""
    rng, vocabulary = random.Random(6), pieces.pieces(pieces.VOCABULARY)
    chunks = ["".join(rng.choices(" ▁abeinost🙂", k=rng.randint(1, 14))) for _ in range(150)] + ["a", " ", "\x00", "🙂🙂"]
    wanted = [vocabulary.n_best(c, 2) for c in chunks]
    monkeypatch.setattr(vocabulary, "lattice", None)
    for chunk, paths in zip(chunks, wanted, strict=True):
        ids, score, loss = vocabulary.best_path(chunk)
        assert score == paths[0][0] and loss == (paths[0][0] - paths[1][0] if len(paths) > 1 else float("inf"))
        assert tuple(ids) in [p for s, p in paths if s == score]
