"""Clauses through the stored index against their patterns over all rows."""

from __future__ import annotations

import re

import pytest

from storyloom.plans.query_language import compile_clauses, parse
from storyloom.plans.search_index import SearchIndex

ROWS = [
    (1, "The big model", "of the people"), (2, "nothing", "The  of. THE"), (3, None, "a foo-bar, b"), (4, "foo", "bar"), (5, "x.NET y", None), (6, "привет мир", "the-end of-the"), (7, "", ""),
    (8, "theory", "off thee"), (9, "the", "of"), (10, "a1b2 the", "of the" * 3), (11, "x", "foo bar"), (12, "x", "foo -- bar foo-bar"),
]
SCHEMA = "id long, title string, summary string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    found = SearchIndex(spark, str(tmp_path_factory.mktemp("words")))
    assert found.add(spark.createDataFrame(ROWS[:5] + [(11, "old", "the old text")], SCHEMA), 0) and found.add(spark.createDataFrame(ROWS[5:], SCHEMA), 1)
    assert not found.add(spark.createDataFrame(ROWS[:1], SCHEMA), 1)
    return found


@pytest.mark.parametrize("q", ["the", "-the", '"of the"', '-"of the"', "foo-bar", '"foo bar"', "-foo", ".net", "привет", "-привет", "the -of", "a1b2", '"-- bar"', "absent", "-absent", '"old text"', "old", ""])
def test_index_gives_what_patterns_give(spark, index, q):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    wanted = sorted(r["id"] for r in rows.where(compile_clauses(parse(q))).collect())
    assert sorted(r["id"] for r in index.matching(rows, parse(q)).collect()) == wanted


def test_a_clause_reads_the_folders_of_its_words(index):
    plan = index.candidates("the")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(word), EqualTo(word,the)" in plan


def test_postings_are_made_without_a_shuffle(spark, tmp_path, monkeypatch):
    made = SearchIndex(spark, str(tmp_path / "w"))
    monkeypatch.setattr(SearchIndex, "commit", lambda self, number, frames: frames["postings"])
    rows = made.add(spark.createDataFrame(ROWS, SCHEMA), 0)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    wanted = {}
    for id_, *fields in ROWS:
        for field, value in enumerate(fields):
            for place, word in enumerate(re.split("[^a-z0-9]+", (value or "").lower())):
                if word:
                    wanted.setdefault((word, id_, field), []).append(place)
    found = rows.collect()
    assert {(r["word"], r["id"], r["field"]): r["places"] for r in found} == wanted and len(found) == len(wanted)
