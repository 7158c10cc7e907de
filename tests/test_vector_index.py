"""The vector index against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import clusters, vector_index
from storyloom.operators.vector_index import StoredIndex, VectorIndex, unit_rows
from storyloom.streaming.store import BatchStore

SCHEMA = "id long, vector array<double>"


def clustered(n=1200, groups=30, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 16))
    return [(k, (centres[rng.integers(groups)] + spread * rng.normal(size=16)).tolist()) for k in range(n)]


def plain(rows, queries):
    """The nearest other id of each query; ties to the smallest id."""
    ids, unit = np.array([i for i, _ in rows]), unit_rows([v for _, v in rows])
    found = {}
    for i, v in queries:
        sim = (unit * unit_rows([v])).sum(axis=1)
        sim[ids == i] = -np.inf
        best = sim.max()
        found[i] = (int(ids[sim >= best - 1e-12].min()), round(float(best), 9))
    return found


def of(df):
    return {r["id"]: (r["nearest_id"], round(r["similarity"], 9)) for r in df.collect()}


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_nearest_is_brute_force(spark, spread, monkeypatch):
    rows = clustered(400, spread=spread) + [(2000 + k, v) for k, (_, v) in enumerate(clustered(400, spread=spread)[:20])] + [(3000, [0.0] * 16), (3001, [0.0] * 16)]
    df = spark.createDataFrame([*rows, (4000, None), (None, [1.0] * 16)], SCHEMA)
    queries = rows[::7] + rows[-2:]
    monkeypatch.setattr(vector_index, "MEMBERS", 20)
    monkeypatch.setattr(vector_index, "QUERIES", 30)
    assert of(VectorIndex.build(df).nearest(spark.createDataFrame(queries, SCHEMA))) == plain(rows, queries)


def test_within_is_brute_force(spark):
    rows = clustered(500, spread=0.6)
    unit = unit_rows([v for _, v in rows])
    sim = unit @ unit.T
    wanted = {(a, b) for a in range(500) for b in range(a + 1, 500) if sim[a, b] >= 0.8}
    df = spark.createDataFrame(rows, SCHEMA)
    found = VectorIndex.build(df).within(df, 0.8, upwards=True).collect()
    assert len(found) == len(wanted) and {(r["id"], r["other"]) for r in found} == wanted
    with pytest.raises(ValueError, match="above zero"):
        VectorIndex.build(df).within(df, 0.0)


def test_a_tenth_of_the_comparisons_on_clustered_vectors(spark):
    rows = clustered(3000, groups=60)
    df = spark.createDataFrame(rows, SCHEMA)
    index, n = VectorIndex.build(df), 0
    units = vector_index.as_units(df.where("id % 5 = 0")).withColumn("limit", F.lit(2.0))
    n += index.compared(index._asked(units, "home"))
    first = {i: s for i, (_, s) in plain(rows, rows[::5]).items()}
    limits = spark.createDataFrame([(i, float(np.sqrt(max(2 - 2 * s, 0)))) for i, s in first.items()], "id long, limit double")
    n += index.compared(index._asked(units.drop("limit").join(limits, "id"), "further"))
    assert n < 600 * 3000 / 10
    assert of(index.nearest(df.where("id % 5 = 0"))) == plain(rows, rows[::5])


def test_stored_and_appended_to(spark, tmp_path):
    rows = clustered(300)
    store = BatchStore(spark, str(tmp_path / "s"), vector_index.TABLES)
    index = StoredIndex(store)
    assert index.open() is None
    for number, at in enumerate((0, 100, 200)):
        assert store.commit(number, index.added(spark.createDataFrame(rows[at : at + 100], SCHEMA)))
    queries = spark.createDataFrame(rows[::9], SCHEMA)
    assert of(StoredIndex(store).open().nearest(queries)) == plain(rows, rows[::9])
    assert of(index.open(0).nearest(queries)) == plain(rows[:100], rows[::9])


def test_empty(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    for rows in (none, one):
        index = VectorIndex.build(rows)
        assert index.nearest(one).collect() == [] and index.nearest(none).collect() == [] and index.within(one, 0.5).collect() == []


@pytest.mark.parametrize("known_before", [0, 60])
def test_leaders_by_blocks_are_those_of_the_loop(spark, monkeypatch, known_before):
    """Blocks of 40, 160, ... rows, ids apart and vectors without length among them; pairs are looked for among rows that no leader has taken only."""
    rng = np.random.default_rng(8)
    rows = [(3 * k + 1, v) for k, (_, v) in enumerate(clustered(700, groups=12, spread=0.9))]
    rows[200:200] = [(3 * 200, rows[100][1]), (3 * 200 - 1, [0.0] * 16)]
    rows = sorted(rows)
    unit, ids = unit_rows([v for _, v in rows]), [i for i, _ in rows]
    sim, before = (unit[:, None, :] * unit[None, :, :]).sum(axis=2), [k for k in range(known_before) if rng.random() < 0.5]
    leaders, wanted = list(before), {}
    for k in range(known_before, len(rows)):
        near = [(sim[k, x], -ids[x]) for x in leaders if sim[k, x] >= 0.7]
        wanted[ids[k]] = -max(near)[1] if near else ids[k]
        leaders += [] if near else [k]
    looked, pairs = [], clusters.similar_pairs
    monkeypatch.setattr(clusters, "similar_pairs", lambda df, *a, **how: looked.append(df.count()) or pairs(df, *a, **how))
    monkeypatch.setattr(clusters, "FIRST", 40), monkeypatch.setattr(clusters, "GROWTH", 4)
    known = spark.createDataFrame([rows[k] for k in before], SCHEMA) if before else None
    found = clusters.leader_clusters(spark.createDataFrame(rows[known_before:], SCHEMA), 0.7, known, exact=True).collect()
    assert len(found) == len(wanted) and {r["id"]: r["leader"] for r in found} == wanted
    assert len(looked) > 2 and sum(looked) < len(rows) / 2
