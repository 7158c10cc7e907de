"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

from storyloom.plans import catalogue
from tests.oracle import SMALL, connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    same(catalogue.QUERIES[name](spark, SMALL), duck, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry_works_without_the_optional_subpackage(spark, monkeypatch):
    import __spark_entry__

    for gone in ("storyloom.llm", "storyloom.llm.registry", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, gone, None)
    monkeypatch.delattr("storyloom.llm", raising=False)
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(catalogue.ORACLES)
    assert __spark_entry__.entry(spark).columns[0] == "id"
