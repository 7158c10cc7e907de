"""The paged source, hydration, routing of marks and job status."""

from __future__ import annotations

import json

import pytest

from storyloom.operators import state
from storyloom.sources.paged import PagedItems, newest
from storyloom.streaming import ingest
from storyloom.streaming.status import JobStatus


def test_paged_source(spark):
    spark.dataSource.register(PagedItems)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = lambda **o: spark.read.format("paged_items").options(client="tests.paged_client:Pages", channels="a,b", **o).load()
    assert source().count() == 10  # without a time, one page of each channel
    assert source(all="1").count() == 30
    assert source(all="1", limit="7").count() == 14  # most of each channel; the newest of all of them:
    assert sorted(r["id"] for r in newest(source(all="1", limit="7"), 7).collect()) == ["a:27", "a:28", "a:29", "a:30", "b:28", "b:29", "b:30"]
    assert source(all="1", limit="7", since="2024-01-24T00:00:00Z").count() == 14
    with pytest.raises(Exception, match="more than 2 pages"):
        source(all="1", maxpages="2").collect()
    recent = source(since="2024-01-24T00:00:00Z")
    assert recent.count() == 14 and recent.select("id").distinct().count() == 14
    pushed = source(all="1").where("date >= '2024-01-29T00:00:00Z' AND channel = 'b'")
    assert sorted(r["id"] for r in pushed.collect()) == ["b:29", "b:30"]


def test_marks_go_where_the_id_is(spark):
    marks = spark.createDataFrame([("s1", 1), ("x1", 1)], "id string, is_read int")
    of_stories, of_items = state.route_marks(marks, spark.createDataFrame([("s1",), ("s1",)], "id string"))
    assert [r["id"] for r in of_stories.collect()] == ["s1"] and [r["id"] for r in of_items.collect()] == ["x1"]


def test_hydrate(spark):
    link = "https://mail/#inbox/"
    rows = [(1, "email", "", None, link + "m1"), (2, "email", "T", "B", link + "m1"), (3, "telegram", None, None, link + "m1"), (4, None, None, "B", link + "none"), (5, "email", None, None, "")]
    mentions = spark.createDataFrame(rows, "id long, source_type string, raw_title string, raw_body string, gmail_url string")
    messages = spark.createDataFrame([("m1", "S", "Body"), ("m1", "S", "Body"), (None, "x", "y")], "id string, subject string, body string")
    found = state.hydrate(mentions, messages)
    assert found.columns == mentions.columns
    assert {r["id"]: (r["raw_title"], r["raw_body"]) for r in found.collect()} == {1: ("S", "Body"), 2: ("T", "B"), 3: (None, None), 4: (None, "B"), 5: (None, None)}


def test_job_status_follows_a_stream(spark, tmp_path):
    import time

    listener = JobStatus()
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in.parquet"))
        stream = ingest.stream_table(spark, str(tmp_path), "in")
        stream.writeStream.queryName("job").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if listener.jobs.get("job", {}).get("status") == "success":
                break
            time.sleep(0.1)
        row = listener.frame(spark).first()
        assert (row["job"], row["status"], row["ok"]) == ("job", "success", True) and row["started_at"] and row["finished_at"]
    finally:
        spark.streams.removeListener(listener)


def saved(path, channel, page, items):
    folder = path / f"channel={channel}" / f"page={page}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "part.json").write_text("\n".join(json.dumps({"id": i, "date": d, "text": "t"}) for i, d in items))


def test_limit_takes_the_newest_of_a_short_and_a_long_channel(spark, tmp_path):
    spark.dataSource.register(PagedItems)
    saved(tmp_path, "short", 0, [("s1", "2024-01-09T00:00:00Z"), ("s2", None)])
    for k in range(5):
        saved(tmp_path, "long", k, [(f"l{k}{n}", f"2024-01-{2 * k + 1:02d}T0{n}:00:00Z") for n in range(4)])
    df = spark.read.format("paged_items").options(client="storyloom.sources.paged:SavedPages", path=str(tmp_path), channels="short,long,none", all="1", limit="10").load()
    assert [r["id"] for r in newest(df, 10).collect()] == ["l43", "l42", "l41", "l40", "s1", "l33", "l32", "l31", "l30", "l23"]


def test_paged_stream_reads_each_item_once(spark, tmp_path):
    """Runs while pages grow; one run fails after its items were read and is run again, as its offsets were planned."""
    spark.dataSource.register(PagedItems)
    path, out = tmp_path / "pages", []
    options = {"client": "storyloom.sources.paged:SavedPages", "path": str(path), "channels": "a,b"}
    fail = []

    def store(batch, number):
        out.append((number, sorted(r["id"] for r in batch.collect())))
        if fail:
            raise RuntimeError("killed")

    def run():
        ingest.run_batches(spark.readStream.format("paged_items").options(**options).load(), store, str(tmp_path / "c"))

    saved(path, "a", 1, [("a1", "2024-01-01T00:00:00Z"), ("a2", "2024-01-01T00:00:00Z"), ("a0", None)])
    run()
    assert out == [(0, ["a0", "a1", "a2"])]
    run()
    assert len(out) == 1
    saved(path, "a", 2, [("a3", "2024-01-02T00:00:00Z"), ("a1", "2024-01-01T00:00:00Z")])
    saved(path, "b", 1, [("b1", "2023-12-01T00:00:00+02:00")])
    fail.append(1)
    with pytest.raises(Exception, match="killed"):
        run()
    saved(path, "a", 3, [("a4", "2024-01-03T00:00:00Z")])
    fail.clear()
    run()  # finishes the batch that was begun
    run()
    assert out[1:] == [(1, ["a3", "b1"]), (1, ["a3", "b1"]), (2, ["a4"])]


def test_repeated_targets_and_hot_links_keep_their_rows(spark):
    from storyloom.functions import links

    urls = spark.createDataFrame([(k, "https://t.co/hot") for k in range(40)] + [(90, "https://t.co/x"), (91, "https://a.org/t.co"), (92, None), (93, "https://bit.ly/none")], "id long, url string")
    targets = spark.createDataFrame([("https://t.co/hot", "https://bit.ly/2"), ("https://t.co/hot", "https://z.org"), ("https://t.co/hot", None), ("https://bit.ly/2", "https://b.org"),
                                     ("https://bit.ly/2", "https://b.org"), ("https://t.co/x", "https://c.org"), (None, "https://d.org")], "url string, target string")
    found = {r["id"]: r["resolved"] for r in links.resolve(urls, targets).collect()}
    assert len(found) == 44 and links.resolve(urls, targets).count() == 44
    assert {found[k] for k in range(40)} == {"https://b.org"}
    assert [found[k] for k in (90, 91, 92, 93)] == ["https://c.org", "https://a.org/t.co", None, "https://bit.ly/none"]


def test_posts_and_messages_of_one_id_are_chosen_by_an_order(spark):
    messages = spark.createDataFrame([("m1", "S", "b"), ("m1", "A", "z"), ("m1", "A", "y")], "id string, subject string, body string")
    mentions = spark.createDataFrame([(1, "email", None, None, "https://mail/#inbox/m1")], "id long, source_type string, raw_title string, raw_body string, gmail_url string")
    assert state.hydrate(mentions, messages.repartition(3)).select("raw_title", "raw_body").first() == ("A", "y")


def test_status_files_follow_a_job(spark, tmp_path):
    from storyloom.sources import saved

    path = str(tmp_path / "jobs" / "email.json")
    told = lambda: saved.job_statuses(spark, {"email": path, "zz": str(tmp_path / "none")}).collect()
    assert [(r["job"], r["status"], r["ok"]) for r in told()] == [("email", "idle", True), ("zz", "idle", True)]
    with saved.job_status(path, "email", "Mail") as facts:
        assert (told()[0]["status"], told()[0]["label"], told()[0]["finished_at"]) == ("running", "Mail", None)
        facts["message"] = "3 items"
    first = told()[0]
    assert (first["status"], first["message"], first["ok"]) == ("success", "3 items", True) and first["finished_at"] >= first["started_at"]
    with pytest.raises(KeyError), saved.job_status(path, "email"):
        assert told()[0]["finished_at"] == first["finished_at"]
        raise KeyError("gone")
    assert (told()[0]["status"], told()[0]["ok"], told()[0]["message"]) == ("failed", False, "'gone'")
    assert len(list((tmp_path / "jobs").iterdir())) == 1


def test_independent_set_of_long_chains(spark):
    """A chain goes one node in two; more rounds than are put together at once."""
    from storyloom.operators import graph

    nodes = spark.createDataFrame([(k,) for k in range(40)], "node long")
    edges = spark.createDataFrame([(k, k + 1) for k in range(39)], "a long, b long")
    assert sorted(r["node"] for r in graph.first_independent_set(nodes, edges).collect()) == list(range(0, 40, 2))
