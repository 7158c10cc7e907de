"""Streams: logs without lost batches, stories in transactions, dedup by keyed state, paged scans, snapshots."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from storyloom.operators import state
from storyloom.streaming import hashes, ingest, stories
from storyloom.streaming.store import BatchStore, last_of_key


def put(spark, folder, number, rows, schema):
    """One more file of a table that a stream reads."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in.parquet")
    return spark.readStream.schema(schema).parquet(f"{folder}/in.parquet")


class TestLog:
    def test_a_half_written_batch_is_written_again(self, spark, tmp_path):
        log = str(tmp_path / "log")
        append = lambda stream, n: ingest.append_unseen(stream, "k", log, str(tmp_path / f"c{n}"))
        append(put(spark, tmp_path / "a", 0, [(1,), (2,)], "k long"), 1)
        # A lost driver left the next batch's folder with a part of its rows, and no manifest.
        spark.createDataFrame([(3,)], "k long").write.parquet(f"{log}/batch-1-lost")
        os.makedirs(f"{log}.manifest/entry=batch-1/_temporary/0")
        rows = lambda found: sorted((r["k"] for r in found.collect()), key=str)
        assert rows(append(put(spark, tmp_path / "b", 0, [(2,), (3,), (4,), (None,), (None,)], "k long"), 2)) == [1, 2, 3, 4, None]
        found = append(put(spark, tmp_path / "b", 0, [(None,), (1,), (5,)], "k long"), 3)
        assert rows(found) == [1, 2, 3, 4, 5, None] and sorted({r["batch"] for r in found.collect()}) == [0, 1, 2]

    def test_a_complete_result_without_news(self, spark, tmp_path):
        rows = [("a",), ("a",), ("b",)]
        told = lambda s: {r["k"]: r["n"] for r in ingest.run_once(ingest.counts(s, "k"), "complete", str(tmp_path / "c"), str(tmp_path / "out")).collect()}
        assert told(put(spark, tmp_path, 0, rows, "k string")) == {"a": 2, "b": 1}
        assert told(spark.readStream.schema("k string").parquet(f"{tmp_path}/in.parquet")) == {"a": 2, "b": 1}
        assert told(put(spark, tmp_path, 1, [("b",)], "k string")) == {"a": 2, "b": 2}
        empty = spark.readStream.schema("k string").parquet(f"{tmp_path}/in.parquet")
        assert ingest.run_once(ingest.counts(empty.where("false"), "k"), "complete", str(tmp_path / "c2"), str(tmp_path / "o2")).collect() == []


class TestStore:
    def test_any_batch_is_the_fold_of_the_log_up_to_it(self, spark, tmp_path):
        rng, log = random.Random(1), []
        store = BatchStore(spark, str(tmp_path / "s"), {"state": "id long, v long", "other": "x string"})
        wanted = {}
        for number in range(7):
            rows = [(k, rng.randrange(100)) for k in rng.sample(range(12), 5)]
            log.append(dict(rows))
            assert store.commit(number, {"state": spark.createDataFrame(rows, "id long, v long"), "other": spark.createDataFrame([(str(number),)], "x string")})
            if number in (2, 5):
                store.compact(number, {"state": lambda r: last_of_key(r, "id"), "other": lambda r: r})
            wanted[number] = {k: v for batch in log for k, v in batch.items()}
        assert not store.commit(6, {"state": spark.createDataFrame([(0, 0)], "id long, v long")})
        with pytest.raises(ValueError, match="after"):
            store.commit(-5, {"state": spark.createDataFrame([(0, 0)], "id long, v long")})
        for number, state_then in wanted.items():
            assert {r["id"]: r["v"] for r in store.latest("state", "id", number).collect()} == state_then
        assert sorted(r["x"] for r in store.read("other").collect()) == [str(k) for k in range(7)]
        files = {f for f in store.read("state").inputFiles()}
        assert not any("/state/batch-0" in f or "/state/batch-5" in f for f in files)

    @pytest.mark.parametrize("at", [(), (1,), (0, 2), (3,)])
    def test_folds_of_snapshot_logs(self, spark, tmp_path, at):
        """Compacted at any batches, the upserts' folds give what they give over the whole log."""
        rng, rows = random.Random(2), []
        for seq in range(240):
            rows.append((f"x:{rng.randrange(15)}", seq, 1000 + rng.randrange(50), f"u{seq}", f"t{seq}", rng.choice([0, 0, 7, 9]), rng.choice([None, 0, 1, 5]), rng.choice([None, 0, 1])))
        schema = "id string, seen_seq long, seen_at long, url string, title string, created_ts long, source_rank long, is_read long"
        store = BatchStore(spark, str(tmp_path / "s"), {"log": schema})
        for number in range(4):
            store.commit(number, {"log": spark.createDataFrame(rows[60 * number : 60 * number + 60], schema)})
            if number in at:
                store.compact(number, {"log": lambda r: state.still_needed(r, "id", "seen_seq", ("is_read",))})
        whole, kept = spark.createDataFrame(rows, schema), store.read("log").drop("batch")
        if at:
            assert kept.count() < len(rows)
        for fold in (
            lambda r: state.bookmark_snapshots(r.drop("source_rank")), state.playlist_snapshots, lambda r: state.latest_flags(r, "id", ("is_read",), "seen_seq"),
        ):
            assert sorted(map(repr, fold(kept).collect())) == sorted(map(repr, fold(whole).collect()))


def embed(_):
    return F.col("own")


def check(told, title, summary):
    return int(title) % 2 == 1, f"now {title}", ""


class TestStories:
    SCHEMA = "id long, title string, summary string, sender string, gmail_url string, date string, source_type string, own array<double>"

    def items(self):
        rng = random.Random(7)
        rows = []
        for k in range(90):
            axis = rng.randrange(8)
            own = None if k % 20 == 9 else [1.0 if d == axis else rng.random() * 0.2 for d in range(8)]
            rows.append((100 + k, str(k), f"s{axis}", "x", "", "d", "email", own))
        return rows

    def begun(self, spark, folder):
        store = stories.StoryStore(spark, str(folder))
        store.begin(
            spark.createDataFrame([(1, "1", "old", 2, 0, True, 5, 5)], stories.STORY), spark.createDataFrame([(1, [1.0] + [0.0] * 7)], stories.TABLES["vectors"])
        )
        return store

    def state(self, store):
        found = {name: sorted(map(repr, store.read(name).drop("batch").collect())) for name in ("vectors", "mentions", "timeline", "outcomes")}
        return found | {"stories": sorted(map(repr, store.stories().collect()))}

    def test_three_batches_with_a_crash_are_one_run(self, spark, tmp_path, monkeypatch):
        rows = self.items()
        one = self.begun(spark, tmp_path / "one")
        assert one.ingest(spark.createDataFrame(rows, self.SCHEMA), 0, embed, check, 50)
        store, folder = self.begun(spark, tmp_path / "three"), tmp_path / "t"
        run = lambda: stories.persist_stream(
            spark.readStream.schema(self.SCHEMA).parquet(f"{folder}/in.parquet"), store, str(tmp_path / "c"), embed, check, lambda _: 50
        )
        put(spark, folder, 0, rows[:25], self.SCHEMA)
        run()
        put(spark, folder, 1, rows[25:60], self.SCHEMA)
        before, write = self.state(store), BatchStore._write
        wrote = []

        def lost(self, number, kind, frames):
            some = dict(list(frames.items())[:2])
            for name, frame in some.items():
                frame.write.parquet(f"{self.folder}/{name}/batch-{number}-lost")
            wrote.append(number)
            raise RuntimeError("lost between two tables")

        monkeypatch.setattr(BatchStore, "_write", lost)
        with pytest.raises(Exception, match="lost between"):
            run()
        monkeypatch.setattr(BatchStore, "_write", write)
        assert wrote == [1] and self.state(store) == before and store.batches() == [-1, 0]
        run()
        store.shorten(1)
        put(spark, folder, 2, rows[60:], self.SCHEMA)
        run()
        run()
        assert store.batches() == [-1, 0, 1, 2] and self.state(store) == self.state(one)
        outcomes = [r["outcome"] for r in store.read("outcomes").collect()]
        assert len(outcomes) == len(rows) and {"new", "merged", "evolved", "failed"} == set(outcomes)


class TestHashes:
    SCHEMA = "id long, hash string, ok boolean"

    @pytest.mark.parametrize("cuts", [(60,), (1, 20, 60), (30, 31, 60)])
    def test_equals_the_batch_fold_in_any_split(self, spark, tmp_path, cuts):
        rng = random.Random(5)
        rows = [(i, rng.choice(["", "a", "a", "b", "c", "known", None]), rng.random() < 0.4) for i in range(60)]
        known = spark.createDataFrame([("known",), ("known",), ("never",), (None,)], "hash string")
        wanted = {r["id"]: r["status"] for r in state.first_by_hash(spark.createDataFrame(rows, self.SCHEMA), "hash", ["id"], known, F.col("ok")).collect()}
        at = 0
        for k, end in enumerate(cuts):
            stream = put(spark, tmp_path, k, rows[at:end], self.SCHEMA)
            at = end
            found = ingest.run_once(hashes.stream_first_by_hash(stream, "hash", "id", F.col("ok"), known), "append", str(tmp_path / "c"), str(tmp_path / "out"))
        assert {r["place"]: r["status"] for r in found.collect()} == wanted
        assert found.count() == len(rows)

    def test_the_state_has_a_row_for_a_bucket_and_none_for_known_hashes(self, spark, tmp_path):
        rows = [(i, f"h{i % 40}", i % 3 > 0) for i in range(120)]
        known = spark.createDataFrame([(f"h{k}",) for k in range(20)], "hash string")
        wanted = {r["id"]: r["status"] for r in state.first_by_hash(spark.createDataFrame(rows, self.SCHEMA), "hash", ["id"], known, F.col("ok")).collect()}
        for k, part in enumerate((rows[:70], rows[70:])):
            told = hashes.stream_first_by_hash(put(spark, tmp_path, k, part, self.SCHEMA), "hash", "id", F.col("ok"), known, buckets=3)
            found = ingest.run_once(told, "append", str(tmp_path / "c"), str(tmp_path / "out"))
        assert {r["place"]: r["status"] for r in found.collect()} == wanted
        kept = spark.read.format("statestore").load(str(tmp_path / "c")).selectExpr("value.*").collect()
        assert 1 <= len(kept) <= 3 and "h39" in str(kept) and "h19" not in str(kept)

    def test_a_hash_is_forgotten_after_its_time(self, spark, tmp_path, request):
        # A stream with timeouts always has another batch without data to run, so a run that ends has to do without these.
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        request.addfinalizer(lambda: spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled"))
        for keep, wanted in ((1, ["new", "new"]), (10**9, ["duplicate", "new"])):
            for k in range(2):
                stream = put(spark, tmp_path / str(keep), k, [(k, "a", True)], self.SCHEMA)
                found = ingest.run_once(hashes.stream_first_by_hash(stream, "hash", "id", F.col("ok"), keep_ms=keep), "append", str(tmp_path / f"c{keep}"), str(tmp_path / f"out{keep}"))
            assert sorted(r["status"] for r in found.collect()) == wanted
