"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from storyloom.llm import pieces, secrets
from tests.llm.test_models import _plain_words
from tests.llm.test_simhash import plain_fingerprint
from tests.oracle import SMALL, connect


def _windows(text):
    words = _plain_words(text)
    return {tuple(words[s : s + 10]) for s in range(max(len(words) - 9, 1))} if words else set()


def _five_words(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_stages(spark):
    from storyloom.llm.registry import ORACLES

    duck = connect()
    kept = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({ORACLES['op2_quality_rules']}) WHERE kept").fetchall()}
    docs = {i: t for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall() if i in kept}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    sets = {i: _five_words(t) for i, t in docs.items()}
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4 or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    near_of = {i: [j for j in docs if i == j or near(i, j)] for i in docs}
    component = {i: i for i in docs}
    for _ in docs:  # labels fall until nothing changes
        before = dict(component)
        for i in docs:
            component[i] = min(component[j] for j in near_of[i])
        if component == before:
            break
    docs = {i: t for i, t in docs.items() if component[i] == i}
    phrases = set().union(*(_windows(t) for (t,) in duck.sql("SELECT text FROM benchmark").fetchall()))
    sizes = {len(p) for p in phrases}

    def hit(text):
        words = _plain_words(text)
        return any(tuple(words[s : s + n]) in phrases for n in sizes for s in range(len(words) - n + 1))

    docs = {i: secrets.redacted(t) for i, t in docs.items() if not hit(t)}
    vocabulary = pieces.pieces(pieces.VOCABULARY)
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(found) == set(docs)
    for i, r in found.items():
        assert vocabulary.decode(r["ids"]) == docs[i] and r["n_pieces"] == len(r["ids"]) and r["scores"] == sorted(r["scores"], reverse=True)


def test_all_but_the_last_stage_keep_the_columns(spark):
    odd = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, _ids string, id string"
    text = " ".join(f"word{i} and" for i in range(60)) + " password=abcdefgh"
    rows = [(1, text, "en", "s", len(text), *"abcd"), (2, text, "en", "s", len(text), *"abcd"), (3, None, "en", "s", None, *"abcd"), (None, text, None, None, None, *"abcd")]
    df = spark.createDataFrame(rows, odd)
    bench = spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "benchmark_decontamination":
            from storyloom.llm import decontaminate

            df = decontaminate.drop_contaminated(df, bench)
        else:
            df = stage(spark, df, SMALL)
        assert df.columns == [c.split()[0] for c in odd.split(", ")]
    out = {r["doc_id"]: r for r in df.collect()}
    assert set(out) == {1, None} and out[1]["text"].endswith("[assign]") and out[1]["n_chars"] == len(out[1]["text"])


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, very long texts, and one id with two texts go through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    long = " ".join(f"word{i} and" for i in range(40_000))
    one, two = (" ".join(f"{c}{i} and" for i in range(60)) for c in "ab")
    rows = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, one, "en", "s", 1), (2, two, "en", "s", 1), (2, two, "en", "s", 1), (3, None, None, None, None)], schema)
    for k, (df, wanted) in enumerate(((empty, []), (rows, [1, 2, 2]))):
        folder = str(tmp_path / str(k))
        df.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "no such passage here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        found = corpus_pipeline.run(spark, folder).collect()
        assert sorted(r["doc_id"] for r in found) == wanted
        assert {pieces.pieces(pieces.VOCABULARY).decode(r["ids"]) for r in found} == ({long, one, two} if wanted else set())
