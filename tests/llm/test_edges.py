"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from storyloom.llm import decontaminate, language, ngram_model, pieces, quality_net, quality_rules, quotes, secrets, simhash, wordpiece

SCHEMA = "doc_id long, text string, lang string, fp string, term string, w string, key string, id string, score string, kept string, position string, text_key string"
LONG = "word " * 60_000 + "x" * 100_000


def rows():
    texts = [(1, None), (2, ""), (2, ""), (3, " \n\t"), (4, LONG), (None, "some text of no id"), (None, None), (5, "Ünï ▁ code\x00 \U0001f600\r\nline"), (5, "another text with the id of the last")]
    return [(i, t, "en", *["clash"] * 9) for i, t in texts]


def bench_of(spark, empty=False):
    return spark.createDataFrame([] if empty else [(1, "some text of no id"), (2, None), (3, "")], "item_id long, text string")


def labels_of(spark):
    return spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 1), (9, None)], "doc_id long, quality int")


OPERATORS = {
    "simhash": lambda s, df: simhash.near_duplicates(df),
    "quality": lambda s, df: quality_rules.apply_policy(quality_rules.ledger(df)),
    "pieces": lambda s, df: pieces.encode(df),
    "ngrams": lambda s, df: ngram_model.learn_and_score(df),
    "net": lambda s, df: quality_net.classify(df, labels_of(s)),
    "decontaminate": lambda s, df: decontaminate.contamination(df, bench_of(s)),
    "secrets": lambda s, df: secrets.scan(df),
    "redact": lambda s, df: secrets.redact(df),
    "wordpiece": lambda s, df: wordpiece.token_counts(df),
    "language": lambda s, df: language.identify(
        df.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"), "fp"), language.fit(df)
    ),
    "quotes": lambda s, df: quotes.conversations(df.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("lang").alias("role"), "text", "fp")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_each_give_a_row(spark, name):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert len(OPERATORS[name](spark, df).collect()) == len(rows())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_defined_results(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    near = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert near[1, 0] == near[2, 0] == near[3, 0] == near[None, 0] == 1
    assert simhash.keep_first(df).columns == df.columns
    kept = [r["doc_id"] for r in simhash.keep_first(df).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 4, 5, 5] and kept.count(None) == 2
    ledger = {r["doc_id"]: r for r in quality_rules.ledger(df).collect()}
    assert ledger[4]["n_words"] == 60_001 and ledger[4]["n_repeat_words"] == 60_000 and ledger[1]["n_words"] == 0
    assert quality_rules.keep_passing(df).columns == df.columns
    clean = decontaminate.drop_contaminated(df, bench_of(spark))
    assert clean.columns == df.columns
    hit = decontaminate.contamination(df, bench_of(spark)).where("contaminated").collect()
    assert [(r["doc_id"], r["n_hit"], r["n_items"]) for r in hit] == [(None, 5, 1)]
    assert decontaminate.contamination(df, bench_of(spark, empty=True)).where("contaminated").count() == 0
    assert all(r["round_trip"] for r in pieces.encode(df).collect())
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(pieces.encode(df)).collect()}
    assert back == {(i, t or "") for i, t, *_ in rows()}
    scored = {(r["doc_id"], r["n_tokens"]): r for r in ngram_model.learn_and_score(df).collect()}
    assert scored[1, 1]["n_known"] == 1 and scored[4, 60_002]["held_out"] is False


def test_of_repeated_ids_what_is_no_copy_stays(spark):
    told = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(7, told[0], "b"), (7, told[0], "a"), (7, told[1], "c"), (3, told[1], "d"), (9, told[2], "e"), (9, told[3], "f"), (9, told[2] + " more", "g"), (None, told[0], "h")]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, times string").withColumns({"id": F.lit(1), "row": F.lit(2), "n": F.lit(3)})
    for how in ({}, {"similarity": 0.8}):
        out = simhash.keep_first(df, **how)
        assert out.columns == df.columns
        kept = sorted((str(r["doc_id"]), r["times"]) for r in out.collect())
        near = {r["times"] for r in out.where("doc_id = 9").collect()}
        assert [x for x in kept if x[0] != "9"] == [("3", "d"), ("7", "a"), ("None", "h"), ("None", "h")]
        assert "f" in near and len(near & {"e", "g"}) == 1


@pytest.mark.parametrize("total", [2, 3000])
def test_a_third_of_all_rows_on_one_key(spark, total):
    """Heavy keys are broadcast, light ones shuffled; together they are a plain join."""
    from storyloom.llm.common import join_counted

    rows = [(i, 0 if i % 3 == 0 else i % 11, "x") for i in range(900)] + [(1000, None, "x")]
    df = spark.createDataFrame(rows, "id long, key long, other string")
    counted = df.groupBy("key").agg(F.count("*").alias("n"), F.sum("id").alias("total"))
    found = {(r["id"], r["total"]) for r in join_counted(df, counted.where("key < 8"), "key", total * 1000).collect()}
    sums = {k: sum(i for i, key, _ in rows if key == k) for k in range(8)}
    assert found == {(i, sums[k]) for i, k, _ in rows if k is not None and k < 8}
    assert join_counted(df, counted, "key", total * 1000, "left_semi").count() == 900


def test_copies_of_one_text_by_the_thousand(spark):
    told = " ".join(f"w{i}" for i in range(80))
    near = [told.replace(f"w{i} ", f"v{i} ") for i in range(3, 70)]
    rows = [(i, told) for i in range(3000)] + [(5000 + i, t) for i, t in enumerate(near)] + [(9000, "all else " + " ".join(f"u{i}" for i in range(80)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, similarity=0.8).collect()}
    assert found == {i: 0 for i, _ in rows[:-1]} | {9000: 9000}
    assert sorted(r["doc_id"] for r in simhash.keep_first(df, similarity=0.8).collect()) == [0, 9000]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_without_adaptive_execution(spark, name):
    """The rows are the same when plans stay as they were made."""
    df = spark.createDataFrame(rows(), SCHEMA)
    told = lambda: sorted(map(repr, OPERATORS[name](spark, df).collect()))
    wanted = told()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert told() == wanted
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_decontamination_of_repeated_rows_beyond_the_broadcast(spark, monkeypatch):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, text)] * 40 + [(2, "x " + text), (None, text), (3, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text), (2, "twelve")], "item_id long, text string")
    told = lambda: sorted(map(repr, decontaminate.contamination(docs, bench).collect()))
    wanted = told()
    assert sum("contaminated=True" in r for r in wanted) == 42
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", 0)
        assert told() == wanted
        monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", 500_000)
        assert told() == wanted
    spark.conf.set("spark.sql.adaptive.enabled", "true")
