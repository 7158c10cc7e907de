"""The filter language."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from storyloom.plans.query_language import Clause, compile_clauses, parse, parse_age

SCHEMA = "title string, summary string, source_type string, primary_url_host string, is_read boolean, skipped boolean, age_days long, all_senders array<string>"


@pytest.mark.parametrize(
    ("q", "clauses"),
    [("ai", [Clause("", "ai")]), ('"big model"', [Clause("", "big model")]), ("-ai", [Clause("", "ai", True)]), ('-sender:"A B"', [Clause("sender", "A B", True)]),
     ("sender: foo", [Clause("", "sender:"), Clause("", "foo")]), ('"unclosed foo', [Clause("", "unclosed"), Clause("", "foo")]), ('""', []), ("-", [Clause("", "-")]),
     ("http://x.com", [Clause("http", "//x.com")]), ("SITE:X.com", [Clause("site", "X.com")])],
)
def test_parse(q, clauses):
    assert parse(q) == clauses


@pytest.mark.parametrize(("age", "found"), [(">7d", (">", 7)), ("<=2mo", ("<=", 60)), ("3w", ("=", 21)), ("1week", None), ("1 YR", ("=", 365)), ("x", None)])
def test_age(age, found):
    assert parse_age(age) == found


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet='ab:-"\\E .*', max_size=8))
def test_negation_is_the_complement(spark, q):
    df = spark.createDataFrame([("a.b", "x", "email", "a.org", True, None, None, ["A b"]), (None, None, None, None, None, None, 3, None)], SCHEMA)
    for clause in parse(q):
        kept = df.where(compile_clauses([clause])).count()
        assert kept + df.where(compile_clauses([Clause(clause.op, clause.value, not clause.negated)])).count() == 2
