"""Registered queries against their SQL, and the contract's columns, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from storyloom.llm import registry
from tests.oracle import SMALL, connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
COLUMNS = {
    "op1": ["doc_id", "fingerprint", "component_id"],
    "op2": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op9": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    same(registry.QUERIES[name](spark, SMALL), connect(), registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_one_row_per_input_row(spark, name):
    table = "pages" if name.startswith("op8") else "documents"
    found = registry.QUERIES[name](spark, SMALL)
    assert found.count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    assert set(COLUMNS.get(name.split("_")[0], [])) <= set(found.columns)
