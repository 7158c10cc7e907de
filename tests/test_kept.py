"""Logs as a sink, counts kept up to date, pages of the feed, stored answers and table functions."""

from __future__ import annotations

import glob
import os
import random
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from storyloom.functions import tables
from storyloom.operators import answers, kept_counts
from storyloom.plans import feed
from storyloom.sources.log_sink import Log, UpsertLog
from storyloom.streaming.ingest import run_batches


@pytest.fixture
def log(spark, tmp_path):
    spark.dataSource.register(UpsertLog)
    path = str(tmp_path / "log")
    write = lambda df, **o: df.write.format("upsert_log").options(path=path, **o).mode("append").save()
    return path, write, lambda: spark.read.format("upsert_log").option("path", path).load()


class TestSink:
    def test_a_failed_job_leaves_nothing(self, spark, log):
        path, write, read = log
        write(spark.range(100).repartition(4), batch="a")

        @F.udf("long")
        def breaks(x):
            if x == 77:
                raise RuntimeError("lost")
            return x

        with pytest.raises(Exception, match="lost"):
            write(spark.range(100).repartition(4).select(breaks("id").alias("id")), batch="b")
        assert sorted(r["id"] for r in read().collect()) == list(range(100))
        time.sleep(1)  # tasks that were at work when the job failed may end now
        assert sorted(r["id"] for r in read().collect()) == list(range(100))
        Log({"path": path}).sweep(0.0)
        named = {f for c in UpsertLog({"path": path}).reader(None).log.commits() for f in c["files"]}
        assert {os.path.relpath(f, path) for f in glob.glob(f"{path}/rows/*.parquet")} == named
        write(spark.range(100, 120), batch="b")
        write(spark.range(100, 120), batch="b")
        assert sorted(r["id"] for r in read().collect()) == list(range(120))

    def test_streamed_batches_once_each(self, spark, log, tmp_path):
        path, _, read = log
        spark.range(50).write.parquet(f"{tmp_path}/in")

        def run(checkpoint):
            stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
            writer = stream.writeStream.format("upsert_log").options(path=path, name="job", checkpointLocation=str(tmp_path / checkpoint))
            writer.trigger(availableNow=True).start().awaitTermination()

        run("c1")
        run("c2")  # the same batch under the same name, as after a lost checkpoint
        assert sorted(r["id"] for r in read().collect()) == list(range(50))

    def test_empty(self, spark, log):
        _, write, read = log
        with pytest.raises(Exception, match="nothing was committed"):
            read()
        write(spark.range(0))
        assert read().columns == ["id"] and read().count() == 0


class TestCounts:
    SCHEMA = "id long, source_type string, skipped boolean, new_info_count long, is_read boolean, last_updated long"

    @staticmethod
    def counted(row):
        return kept_counts.facet(row) + kept_counts.story_stats(row)

    def test_ten_batches_equal_a_recount(self, spark, tmp_path):
        rng, now = random.Random(4), 100 * 86400
        kept, last, states = kept_counts.KeptCounts(spark, str(tmp_path / "k"), self.SCHEMA, self.counted), {}, []
        for number in range(10):
            rows = [(i, rng.choice("abc"), rng.random() < 0.3, rng.randrange(3), rng.random() < 0.5, rng.randrange(60, 101) * 86400 + rng.choice([0, 1, 5000])) for i in rng.sample(range(40), 12)]
            last |= {r[0]: r for r in rows}
            df = spark.createDataFrame([*rows, (None, "a", False, 1, False, now)], self.SCHEMA)
            assert kept.apply(df, number) and not kept.apply(df, number)
            if number in (3, 8):
                kept.shorten(number)
            states.append(spark.createDataFrame(list(last.values()), self.SCHEMA))
        for number in (0, 3, 5, 9):
            counts = kept.counts(number)
            assert list(map(tuple, kept_counts.facets(counts).collect())) == list(map(tuple, feed.facets(states[number]).collect()))
            mentions = spark.createDataFrame([], "id long")
            whole = feed.stats(states[number], mentions, now).first()
            assert tuple(kept_counts.stats(counts, now).first()) == (whole["stories"], whole["evolved"], whole["unread_30_days"])

    def test_only_folders_of_touched_ids_are_read(self, spark, tmp_path):
        kept = kept_counts.KeptCounts(spark, str(tmp_path / "k"), self.SCHEMA, self.counted)
        kept.apply(spark.createDataFrame([(i, "a", False, 0, False, 5) for i in range(500)], self.SCHEMA), 0)
        bucket = F.pmod(F.xxhash64(F.lit(7).cast("long")), F.lit(kept_counts.BUCKETS)).cast("int")
        number = spark.range(1).select(bucket).first()[0]
        plan = kept.store.read("rows").where(F.col("bucket") == number)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan


class TestPages:
    def rows(self, spark):
        rng = random.Random(6)
        rows = [(k, rng.choice([None, 10, 20, 30]), rng.randrange(2), rng.choice([5, 6]), rng.randrange(3), rng.randrange(2), 1, ["a"], "", "") for k in range(97)]
        schema = "id long, sort_ts long, source_rank long, last_updated long, mention_count long, new_info_count long, distinct_sender_count int, distinct_source_types array<string>, primary_image_url string, primary_url string"
        return spark.createDataFrame(rows, schema)

    @pytest.mark.parametrize("sort", ["recent", "score", "mentions", "evolved", "oldest"])
    def test_pages_together_are_the_whole_order(self, spark, sort):
        rows = self.rows(spark)
        whole, found, last = [r["id"] for r in feed.ordered(rows, sort, 100).collect()], [], None
        for _ in range(6):
            page = feed.page(rows, sort, 100, 20, last).collect()
            found += [r["id"] for r in page]
            last = page[-1] if page else last
        assert found == whole and len(set(found)) == 97

    def test_a_page_is_a_top_k(self, spark):
        rows = self.rows(spark)
        plan = feed.page(rows, "recent", 100, 5, feed.page(rows, "recent", 100, 5).collect()[-1])._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan and "\n+- Sort" not in plan


class TestAnswers:
    def test_each_prompt_is_asked_once_and_failures_again(self, spark, tmp_path):
        asked = spark.sparkContext.accumulator(0)

        def make(broken):
            def call(prompt):
                asked.add(1)
                if broken and prompt == "bad":
                    raise ValueError("no luck")
                return None if prompt == "silent" else prompt.upper()

            return lambda: call

        rows = spark.createDataFrame([(k, "hot") for k in range(30)] + [(90, "bad"), (91, "silent"), (92, None), (93, ""), (94, "x")], "id long, prompt string")
        store = answers.AnswerStore(spark, str(tmp_path / "a"))
        assert store.ask(rows, make(True)) == 0 and asked.value == 5
        told = lambda: {r["id"]: (r["answer"], r["error"]) for r in store.answered(rows).collect()}
        first = told()
        assert len(first) == 35 and first[0] == first[29] == ("HOT", None) and first[92] == (None, None) and first[93] == ("", None)
        assert first[90] == (None, "ValueError: no luck") and first[91] == (None, "no answer")
        store.ask(rows, make(False))
        assert asked.value == 7 and told()[90] == ("BAD", None) and told()[91] == (None, "no answer")
        store.ask(rows.where("prompt <> 'silent'"), make(True))
        assert asked.value == 7
        assert store.read("failures").count() == 3
        other = answers.AnswerStore(spark, str(tmp_path / "a"), "another model")
        other.ask(rows.where("id = 94"), make(True))
        assert asked.value == 8


class TestTableFunctions:
    def test_rows_of_pages_and_mails(self, spark):
        tables.register(spark)
        spark.createDataFrame([(1, "<a href='/x'>One</a> <a href='https://b.org'>Two <b>b</b></a>"), (2, None), (3, "no link")], "id long, html string").createOrReplaceTempView("some_pages")
        found = spark.sql("SELECT p.id, l.pos, l.anchor, l.href FROM some_pages p, LATERAL page_links(p.html) l ORDER BY 1, 2").collect()
        assert list(map(tuple, found)) == [(1, 0, "One", "/x"), (1, 1, "Two b", "https://b.org")]
        assert spark.sql("SELECT * FROM page_links('<a href=\"u\">t</a>')").collect()[0]["context"] == "t"
        assert spark.sql("SELECT m.title FROM (SELECT 'A title\nthe body' AS body) t, LATERAL mail_stories(t.body, 'offline') m").count() == 1
        with pytest.raises(AnalysisException, match="a text is wanted"):
            spark.sql("SELECT * FROM page_links(3)").collect()
        with pytest.raises(AnalysisException, match="constant"):
            spark.sql("SELECT m.title FROM some_pages t, LATERAL mail_stories(t.html, t.html) m").collect()


def test_run_batches_hands_each_batch_in_once(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    seen = []
    for _ in range(2):
        run_batches(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda b, n: seen.append((n, b.count())), str(tmp_path / "c"))
    assert seen == [(0, 3)]
