"""What piece encoding holds: slices of a batch, and one string of bytes for each remembered chunk."""

from __future__ import annotations

from array import array

import pytest

from storyloom.functions import slices
from storyloom.llm import pieces


def test_a_remembered_chunk_is_one_string_of_bytes():
    vocabulary = pieces.pieces(pieces.VOCABULARY)
    encoder, text = pieces.Encoder(vocabulary, 4), "words of a text ▁ and émigré words, twice the words"
    ids, scores, others = encoder.encode(text)
    assert all(isinstance(value, bytes) for value in encoder.values())
    found = [vocabulary.best_path(chunk) for chunk in pieces.CHUNKS.findall(" " + text)]
    assert ids.tolist() == [x for chunk, _, _ in found for x in chunk] and scores[0] == sum(score for _, score, _ in found)
    assert [array("i", value[pieces.HEAD.size :]).tolist() for value in (encoder[c] for c in pieces.CHUNKS.findall(" " + text))] == [list(x) for x, _, _ in found]
    assert vocabulary.decode(ids.tolist()) == text and len(others) == 4
    assert all(vocabulary.decode(pieces.changed(ids.tolist(), change)) == text for change in others)


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_slices_give_what_batches_give(spark, monkeypatch, most):
    monkeypatch.setattr(slices, "SLICE_BYTES", most)
    df = spark.createDataFrame([(k, None if k % 7 == 3 else f"text {k} " * (k % 5)) for k in range(40)], "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r for r in pieces.encode(df).collect()}
    assert len(found) == 40 and all(r["round_trip"] for r in found.values())
    assert found[9]["ids"] == pieces.encoder(pieces.VOCABULARY, 4).encode("text 9 " * 4)[0].tolist()
