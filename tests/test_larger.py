"""What showed on larger tables: rare texts, and steps whose cost has to grow with the input only."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from storyloom.functions import links, slices, text
from storyloom.operators import models, vector_index
from storyloom.operators.vector_index import VectorIndex
from storyloom.plans import item_queries, source_queries
from storyloom.sources import channels, mail
from tests.oracle import connect, same


def documents(folder, texts) -> str:
    n = range(len(texts))
    rows = {"doc_id": pa.array(n, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(texts), "source": ["web"] * len(texts)}
    pq.write_table(pa.table(rows), f"{folder}/documents.parquet")
    return str(folder)


def test_words_that_cancel_each_other_have_a_vector(spark, tmp_path):
    met, pair = {}, None
    for k in range(2000):
        digest = hashlib.md5(f"w{k}".encode()).digest()
        place, sign = int.from_bytes(digest[:4], "little") % 64, digest[4] & 1
        pair = pair or ((met[place, 1 - sign], f"w{k}") if (place, 1 - sign) in met else None)
        met[place, sign] = f"w{k}"
    assert any(models.Offline().embed(" ".join(pair)))
    assert not any(models.Offline().embed("... !"))
    folder = documents(tmp_path, [" ".join(pair), f"{pair[0]}, {pair[1]} {pair[1]} {pair[0]}", "one", "...", "", None])
    same(item_queries.embed_texts(spark, folder), connect(folder), item_queries.ORACLES["embed_texts"])


def test_a_query_is_sent_once_to_a_group_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, v) for k, v in enumerate(rng.normal(size=(600, 32)).tolist())]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    units = vector_index.as_units(df).withColumn("limit", F.lit(1.1))
    index = VectorIndex.build(df)
    assert index.compared(index._asked(units, "within")) > 600 * 300  # hardly a cell is passed over
    assert index._asked(units, "within").count() == 600
    monkeypatch.setattr(vector_index, "MEMBERS", 200)
    assert index._asked(units, "within").count() <= 600 * 6
    unit = vector_index.unit_rows([v for _, v in rows])
    wanted = {(int(a), int(b)) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.4), strict=True) if a < b}
    assert {(r["id"], r["other"]) for r in index.within(df, 0.4, upwards=True).collect()} == wanted


def test_one_cell_of_copies_goes_in_parts(spark, monkeypatch):
    for name, most in (("MEMBERS", 16), ("QUERIES", 16), ("PAIRS", 7)):
        monkeypatch.setattr(vector_index, name, most)
    df = spark.createDataFrame([(k, [1.0, 2.0, 3.0] if k % 4 else [float(k), -1.0, 0.5]) for k in range(80)], "id long, vector array<double>")
    found = VectorIndex.build(df).within(df.where("id % 4 > 0"), 0.999, upwards=True).where("id % 4 > 0 AND other % 4 > 0")
    assert found.select("id", "other").distinct().count() == found.count() == 60 * 59 // 2


def test_python_makes_of_a_batch_a_slice_at_a_time(monkeypatch):
    made, column = [], pa.array(["x" * 1000] * 5000)

    def run(part: pa.Array) -> pa.Array:
        made.append(part.nbytes)
        return part

    monkeypatch.setattr(slices, "SLICE_BYTES", 100_000)
    found = pa.chunked_array(list(slices.by_slices(run)(iter([column, column[:0]]))))
    assert found.to_pylist() == column.to_pylist() and max(made) <= 101_000 and len(made) > 40


def test_udfs_on_texts_go_by_slices():
    for udf in (text.unescape_html, links.links_in_context, mail.mime_bodies, channels.page_posts):
        assert list(udf.func(iter([pa.array(["a", None, "b"])])))[0] is not None


def test_mails_are_read_once_and_one_mail_is_looked_for_first(spark, tmp_path):
    folder = documents(tmp_path, [f"A text of number {k}, long enough for a letter that is not short. " * 2 for k in range(60)])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    all_of_them = plan(source_queries.QUERIES["newsletters"](spark, folder))
    assert "Union" not in all_of_them and not [x for x in all_of_them.splitlines() if "Filter" in x and "to_json" in x]
    one = [x for x in plan(source_queries.QUERIES["newsletter_by_id"](spark, folder)).splitlines() if "Filter" in x]
    assert one and "to_json" not in "".join(one)
    for name in ("newsletters", "newsletter_by_id", "mail_outcomes"):
        same(source_queries.QUERIES[name](spark, folder), connect(folder), source_queries.ORACLES[name])
