"""Hard negatives, vector codes and archives against plain versions, on odd rows, ties, hot keys and empty tables."""

from __future__ import annotations

import glob
import gzip
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import negatives, negatives_queries, vector_codes, vector_codes_queries, warc, warc_queries
from tests.oracle import connect, rows_of

VECTORS = "vec_id long, embedding array<float>, label int, tile string, uid string, v string"


def same_as_sql(df, connection, sql):
    found = connection.sql(sql)
    assert rows_of(df.columns, df.collect()) == rows_of(found.columns, found.fetchall())


def written(spark, tmp_path, name, rows, schema):
    """A table in a folder as the queries read it, and a connection that sees it."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    connection = connect(str(tmp_path / "none"))
    connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return connection


def vectors(n=400, hot=130, seed=1):
    """A third of the rows share one vector and label; ties, repeats, clusters and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 16))
    rows = [(k, centres[k % 6] + 0.2 * rng.normal(size=16), k % 5) for k in range(n)]
    rows += [(n + k, centres[0], 1) for k in range(hot)]
    rows += [(2 * n + k, rows[k][1], (rows[k][2] + 1) % 5) for k in range(60)]
    return [(i, [float(x) for x in v], label) for i, v, label in rows]


def odd_vectors():
    v = [0.5] * 16
    return [(900, None, 1), (901, [None, *v[1:]], 1), (902, [float("nan"), *v[1:]], 1), (903, [float("inf"), *v[1:]], 1), (904, v, None)]


def clash(rows):
    return [(*r, "clash", "clash", "clash") for r in rows]


class TestNegatives:
    def test_matches_sql(self, spark, tmp_path):
        rows = clash(vectors() + odd_vectors())
        connection = written(spark, tmp_path, "embeddings", [*rows, *rows[:7]], VECTORS)
        found = negatives_queries.op11_negatives(spark, str(tmp_path))
        assert found.count() > 50
        same_as_sql(found, connection, negatives_queries.ORACLES["op11_negatives"])

    @pytest.mark.parametrize("tile_rows,leaf_rows", [(64, 4), (50, 64), (1000, 7)])
    def test_any_tiles(self, spark, tile_rows, leaf_rows):
        df = spark.createDataFrame(clash(vectors()), VECTORS)
        rows = negatives.rows_of(df)
        found = negatives.mine(rows, F.col("id") % 10 == 0, tile_rows=tile_rows, leaf_rows=leaf_rows)
        assert sorted(map(tuple, found.collect())) == plain_negatives(vectors(), 10)

    def test_without_adaptive_execution(self, spark):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            rows = negatives.rows_of(spark.createDataFrame(clash(vectors()), VECTORS))
            found = negatives.mine(rows, F.col("id") % 50 == 0, tile_rows=100)
            assert sorted(map(tuple, found.collect())) == plain_negatives(vectors(), 50)
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")

    def test_large_components_stay_exact(self, spark):
        rows = [(i, [x * 5e4 for x in v], label) for i, v, label in vectors(60, 0)[:60]]
        found = negatives.mine(negatives.rows_of(spark.createDataFrame(clash(rows), VECTORS)), F.col("id") % 10 == 0)
        assert sorted(map(tuple, found.collect())) == plain_negatives(rows, 10)

    def test_empty(self, spark):
        for rows in ([], clash(odd_vectors()), clash(vectors(60, 0)[:1])):
            df = spark.createDataFrame(rows, VECTORS)
            assert negatives.mine(negatives.rows_of(df), F.col("id") % 50 == 0).collect() == []

    def test_boxes_are_passed_over(self):
        """On clustered rows the walk scores a part of the leaves, and finds what all of them hold."""
        rng = np.random.default_rng(5)
        centres = rng.normal(size=(32, 8)) * 400
        data = (np.repeat(centres, 64, axis=0) + rng.normal(size=(2048, 8)) * 10).astype(np.int32)
        order = negatives.str_order(data[:, :3], 64)
        data = data[order]
        leaves = [data[k : k + 64] for k in range(0, 2048, 64)]
        import pyarrow as pa

        table = pa.table({
            "leaf": list(range(32)), "ids": [list(range(k * 64, k * 64 + 64)) for k in range(32)], "labels": [[0] * 64] * 32, "data": [x.tobytes() for x in leaves],
            "lo": [x.min(axis=0).tobytes() for x in leaves], "hi": [x.max(axis=0).tobytes() for x in leaves], "label_lo": [0] * 32, "label_hi": [0] * 32,
        })
        walk = negatives.Walk(table, 8, np.float64, 5, True)
        seen = []
        walk.data = [Counted(x, seen) for x in walk.data]
        q = data[7].astype(np.float64)
        lower, upper = negatives.intervals(q[None, :], walk.tree.lo, walk.tree.hi)
        found = walk.found(-1, 0, q, [negatives.LOWEST], [negatives.HIGHEST], [negatives.LOWEST], lower[0], upper[0])[0]
        scores = data.astype(np.int64) @ data[7].astype(np.int64)
        assert found == sorted((-int(s), k, 0) for k, s in enumerate(scores))[:5]
        assert len(seen) <= 8


class Counted:
    def __init__(self, data, seen):
        self.data, self.seen = data, seen

    def __matmul__(self, q):
        self.seen.append(1)
        return self.data @ q


def plain_negatives(rows, every, positives=5, negatives_=3):
    ints = {i: ([int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows}
    found = []
    for a in [i for i in ints if i % every == 0]:
        score = {i: sum(x * y for x, y in zip(ints[a][0], v, strict=True)) for i, (v, _) in ints.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if ints[i][1] == ints[a][1]][:positives]:
            fitting = [i for i in order if ints[i][1] != ints[a][1] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            found += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fitting[:negatives_])]
    return sorted(found)


class TestCodes:
    def test_matches_sql(self, spark, tmp_path):
        rows = clash(vectors() + [(None, [0.25] * 16, None), (905, [0.1] * 16, None)] + [r for r in odd_vectors() if r[0] != 904])
        connection = written(spark, tmp_path, "embeddings", rows + rows[100:103], VECTORS)
        found = vector_codes_queries.op12_vector_codes(spark, str(tmp_path))
        assert found.count() == 400 + 130 + 60 + 2 + 3
        same_as_sql(found, connection, vector_codes_queries.ORACLES["op12_vector_codes"])

    @pytest.mark.parametrize("seed", range(6))
    def test_candidates_hold_the_nearest(self, seed):
        rng = np.random.default_rng(seed)
        scale = [3, 40, 4000, 1 << 26][seed % 4]
        entries = rng.integers(-scale, scale, size=(1 + 21 * (seed % 4), 4))
        parts = rng.integers(-2 * scale, 2 * scale, size=(500, 4))
        squared = np.square(parts[:, None, :] - entries[None, :, :]).sum(axis=2)
        first, least = vector_codes.Book(entries).nearest(parts)
        assert (least == squared.min(axis=1)).all()
        assert (first == squared.argmin(axis=1)).all()

    def test_masks_leave_few_candidates(self):
        rng = np.random.default_rng(2)
        book = vector_codes.Book(rng.integers(-100, 100, size=(64, 4)))
        parts = rng.integers(-100, 100, size=(1000, 4))
        masks = book.candidates(parts, book.radius(parts))
        assert np.unpackbits(masks.view(np.uint8)).sum() < 1000 * 64 / 4

    def test_few_and_no_rows(self, spark):
        assert vector_codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
        assert vector_codes.compress(spark.createDataFrame(clash(odd_vectors()[:4]), VECTORS)).collect() == []
        one = vector_codes.compress(spark.createDataFrame(clash([(1, [0.5] * 16, 3), (2, [0.5] * 7, 3)]), VECTORS)).collect()
        assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in one} == {1: ("00" * 16, 0, 0), 2: (None, None, 0)}
        assert one[0]["codebooks_sha256"] == hashlib.sha256(",".join(["128"] * 16).encode()).hexdigest()

    def test_beyond_64_bits_fails(self, spark):
        with pytest.raises(Exception, match="beyond"):
            vector_codes.compress(spark.createDataFrame(clash([(1, [1e9] * 16, 3)]), VECTORS)).collect()


PAGES = "page_id long, url string, html string, file string, digest string, id string"
LONG = "<p>é\U0001f600</p>\r\n\r\n" * 40_000


def pages():
    copy = "<html>" + "the same page " * 20 + "</html>"
    rows = [(k, f"http://host/{k}?q=a b\r\nX: y", f"<p>{k}</p>" * 30) for k in range(40)]
    rows += [(100 + k, f"http://copy/{k}", copy) for k in range(30)]
    rows += [(50, "http://é/", LONG), (51, None, LONG), (52, "u", None), (53, "u", ""), (54, "u", "short"), (55, "u", "short"), (56, "u", "x" * 99), (57, "u", "x" * 99)]
    rows += [(58, "u", "x" * 100), (59, "u", "x" * 100), (None, "u", "x" * 100), (None, "u", "n" * 200), (None, "u", "n" * 200), (100, "again", copy), (58, "u", "x" * 100)]
    return clash(rows)


class TestArchives:
    def test_matches_sql(self, spark, tmp_path):
        connection = written(spark, tmp_path, "pages", pages(), PAGES)
        found = warc_queries.op13_warc(spark, str(tmp_path))
        assert found.where("record_type = 'revisit'").count() >= 30
        same_as_sql(found, connection, warc_queries.ORACLES["op13_warc"])

    def test_repeated_digests_beyond_the_broadcast(self, spark, monkeypatch):
        df = spark.createDataFrame(pages(), PAGES)
        told = lambda: sorted(map(repr, warc.archive_roundtrip(df).collect()))
        wanted = told()
        monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
        assert told() == wanted

    def test_archives_are_plain_warc(self, spark, tmp_path):
        index, folder = warc.write_archives(warc.plan(spark.createDataFrame(pages(), PAGES)), str(tmp_path / "out"), archive_bytes=2000)
        files = glob.glob(f"{tmp_path}/out/archives/*.warc.gz")
        assert {r["file"] for r in index.select("file").distinct().collect()} == {os.path.basename(f) for f in files} and len(files) > 4
        whole = b"".join(gzip.open(f).read() for f in files)
        assert whole.count(b"WARC/1.1\r\n") == len(pages())
        assert b"\r\nX: y" not in whole.replace(b"%0D%0AX:%20y", b"")
        assert sum(map(os.path.getsize, files)) == sum(r["length"] for r in index.collect())

    def test_payloads_of_selected_records(self, spark, tmp_path):
        index, folder = warc.write_archives(warc.plan(spark.createDataFrame(pages(), PAGES)), str(tmp_path / "out"))
        found = warc.payloads(index, folder, F.col("id").isin(50, 51, 52, 3, 101, 117, 100))
        texts = sorted((r["id"], bytes(r["payload"]).decode()) for r in found.collect())
        assert texts == sorted((r[0], r[2] or "") for r in pages() if r[0] in (50, 51, 52, 3, 101, 117, 100))

    def test_ranges_go_over_small_gaps_only(self):
        entries = [(0, 10), (10, 10), (25, 5), (1000, 10), (1010, 500), (1510, 10)]
        assert warc.ranges(entries, most=100, gap=8) == [(0, 3), (3, 4), (4, 5), (5, 6)]
        assert warc.ranges(entries, most=10_000, gap=10_000) == [(0, 6)]
        assert warc.ranges([]) == []

    def test_a_lost_attempt_leaves_nothing_in_the_index(self, spark, tmp_path):
        """A task that writes its archive and fails is run again; the index has each record once, all readable."""
        marker = str(tmp_path / "failed")

        @F.udf("string")
        def breaks(text):
            if text and text.startswith("<p>39") and not os.path.exists(marker):
                open(marker, "w").close()
                raise RuntimeError("lost")
            return text

        df = spark.createDataFrame(pages(), PAGES).coalesce(1)
        planned = warc.plan(df)
        with pytest.raises(Exception, match="lost"):
            warc.write_archives(planned.withColumn("url", breaks(F.decode("payload", "UTF-8"))).coalesce(1), str(tmp_path / "a"))
        assert not os.path.exists(f"{tmp_path}/a/index/_SUCCESS")
        index, folder = warc.write_archives(planned, str(tmp_path / "b"))
        assert warc.read_records(index, folder).count() == len(pages())

    def test_a_changed_archive_is_noticed(self, spark, tmp_path):
        index, folder = warc.write_archives(warc.plan(spark.createDataFrame(pages()[:3], PAGES).coalesce(1)), str(tmp_path / "out"))
        row = index.orderBy("offset").first()
        path = f"{tmp_path}/out/archives/{row['file']}"
        data = bytearray(open(path, "rb").read())
        other = warc.record(row["id"], "u", b"other", "0" * 64, None, False, "d")
        data[: row["length"]] = other.ljust(row["length"], b"\0")[: row["length"]]
        open(path, "wb").write(data)
        with pytest.raises(Exception, match="payload|record|incorrect|zlib"):
            warc.read_records(index, folder).collect()

    def test_empty(self, spark):
        assert warc.archive_roundtrip(spark.createDataFrame([], PAGES)).collect() == []
