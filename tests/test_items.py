"""Vectors, clusters, evolution, model providers, streams and sources."""

from __future__ import annotations

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import clusters, models, similarity
from storyloom.sources import channels, mail, saved
from storyloom.streaming import ingest


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    v = np.repeat(rng.normal(size=(10, 12)), 6, axis=0) + rng.normal(size=(60, 12)) * 0.4
    v = v[rng.permutation(60)]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vector array<double>"), unit @ unit.T


def spark_null(df):
    """Rows without a vector or an id."""
    return df.limit(2).select(F.when(F.col("id") < 0, F.col("id")).alias("id"), "vector").unionByName(df.limit(1).select("id", F.lit(None).cast("array<double>").alias("vector")))


def test_pairs_nearest_and_leaders(vectors):
    df, sim = vectors
    pairs = {(r["a"], r["b"]) for r in similarity.similar_pairs(df, 0.8).collect()}
    assert pairs == {(i, j) for i in range(60) for j in range(i + 1, 60) if sim[i, j] >= 0.8}
    exact = similarity.similar_pairs(df.unionByName(spark_null(df)), 0.8, exact=True)
    assert {(r["a"], r["b"]) for r in exact.collect()} == pairs
    leaders, wanted = [], {}
    for i in range(60):
        near = [(sim[i, k], -k) for k in leaders if sim[i, k] >= 0.8]
        wanted[i] = -max(near)[1] if near else i
        if not near:
            leaders.append(i)
    assert {r["id"]: r["leader"] for r in clusters.leader_clusters(df, 0.8).collect()} == wanted
    others = sim - 9 * np.eye(60)
    assert {r["id"]: r["nearest_id"] for r in similarity.nearest(df.where("id % 10 = 0"), df).collect()} == {i: int(others[i].argmax()) for i in range(0, 60, 10)}


def test_evolve_checks_from_the_third_mention(spark):
    rows = [(1, 1, "a", "x"), (2, 1, "b", "y"), (3, 1, "c", "z"), (4, 1, "", ""), (5, None, "n", "m"), (6, 2, "q", "r")]
    df = spark.createDataFrame(rows, "id long, story_id long, title string, summary string")
    found = clusters.evolve(df, lambda told, title, summary: (True, title, "")).collect()
    assert {r["id"]: (r["outcome"], r["story_summary"]) for r in found} == {
        1: ("new", "x"), 2: ("merged", None), 3: ("evolved", "x c"), 4: ("merged", None), 5: ("new", "m"), 6: ("new", "r")
    }


def test_extraction_drops_meta_titles_and_marks_failures(spark):
    df = spark.createDataFrame([(1, "T\nbody\n\nType A\nz"), (2, None)], "id long, body string")
    rows = models.extract_stories(df).collect()
    assert [(r["id"], r["title"], r["failed"]) for r in sorted(rows, key=lambda r: r["id"])] == [(1, "T", False), (2, None, True)]


def test_rotation_goes_on_only_on_rate_limits():
    def call(model, prompt):
        if model != "c":
            raise RuntimeError("429 too many requests")
        return prompt

    assert models.Rotating(["a", "b", "c"], call).chat("x") == "x"
    with pytest.raises(RuntimeError, match="all models"):
        models.Rotating(["a"], call).chat("x")
    with pytest.raises(ValueError):
        models.provider("nowhere")


def _part(kind, text, **more):
    return {"mimeType": kind, "body": {"data": base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")}} | more


def test_mail(spark, tmp_path):
    body = "A long enough body of a letter, with more than fifty characters in it."
    head = lambda **h: [{"name": k.replace("_", "-"), "value": v} for k, v in h.items()]
    messages = [
        {"id": "1", "snippet": "s", "payload": {"headers": head(Subject="News", From="A <a@b.org>", List_Id="x"), "mimeType": "multipart/alternative",
         "parts": [_part("text/plain", "View in browser"), {"mimeType": "multipart/mixed", "parts": [_part("text/html", f"<p>{body}</p><a href='https://x.org'>go</a>")]}]}},
        {"id": "2", "payload": {"headers": head(Subject="Your invoice", From="a@b.org")} | _part("text/plain", body)},
        {"id": "3", "payload": {"headers": head(Subject="Hi", From="a@b.org")} | _part("text/plain", "short")},
        {"id": "4", "payload": {"headers": head(Subject="Hi", subject="Hello", From="a@b.org")} | _part("text/plain", body + " &amp; ä")},
    ]
    (tmp_path / "m.json").write_text("\n".join(json.dumps(m) for m in messages))
    rows = {r["id"]: r for r in mail.newsletters(mail.read_messages(spark, str(tmp_path / "m.json"))).collect()}
    assert {k: r["outcome"] for k, r in rows.items()} == {"1": "short", "2": "skipped", "3": "short", "4": "ok"}
    assert rows["4"]["subject"] == "Hello" and rows["4"]["body"] == body + " & ä"


PAGE = """<div class="tgme_widget_message_wrap"><div class="tgme_widget_message_photo_wrap" style="background-image:url('https://i/1.jpg')"></div>
<div class="tgme_widget_message_text">Hello<br/>world <a href="https://a.org/1">one</a> <a href="https://a.org/1">again</a><a href="/x">in</a></div>
<a class="tgme_widget_message_link_preview" href="https://p.org/9"></a>
<a class="tgme_widget_message_date" href="https://t.me/chan/42"><time datetime="2024-01-30T00:00:00+00:00"></time></a></div>
<div class="tgme_widget_message_wrap"><a class="tgme_widget_message_date" href="https://t.me/chan/x"></a></div>"""


def test_channel_pages(spark):
    df = spark.createDataFrame([("chan", PAGE), ("chan", None)], "channel string, html string")
    found = channels.posts(df, "now").collect()
    assert [(r["id"], r["text"], r["links"], r["images"], r["is_digest"]) for r in found] == [
        ("tg:chan:42", "Hello\nworld\none\nagain\nin", ["https://p.org/9", "https://a.org/1"], ["https://i/1.jpg"], False)
    ]
    story = channels.post_stories(channels.posts(df, "now")).first()
    assert (story["title"], story["primary_url"], story["outcome"]) == ("Hello", "https://p.org/9", "story")
    assert channels.since(channels.posts(df, "now"), 1_706_000_000).count() == 1


def test_saved_items(spark, tmp_path):
    lines = ['{"tid": "5", "href": "/a/5", "text": "First\\nsecond", "handle": "@a", "authorName": "A", "avatar": "x_normal.jpg", "dt": "2024-01-30T00:00:00Z", "media": [{"type": "i", "url": ""}, {"type": "i", "url": "u"}]}', "no json"]
    (tmp_path / "p.json").write_text("\n".join(lines))
    row = saved.social_posts(saved.read(spark, str(tmp_path / "p.json"), saved.POSTS)).where("id is not null").first()
    assert (row["id"], row["url"], row["title"], row["cover"], row["author"], row["avatar"]) == ("twitter:5", "https://x.com/a/5", "First", "u", "A @a", "x_400x400.jpg")
    videos = spark.createDataFrame([("v", None, None, " ", "Up", None, 3, 65.0, [("small", 1, 2), ("big", 3, 4), ("same", 4, 3)]), ("", None, None, None, None, None, None, None, None)], saved.VIDEOS)
    row = saved.playlist_items(videos, 1000).collect()
    assert len(row) == 1
    assert (row[0]["title"], row[0]["excerpt"], row[0]["cover"], row[0]["created_ts"]) == ("(untitled)", "Up · 1:05", "big", 998)
    updates = spark.createDataFrame([("u", None, "", "Ann", "Boss", None, None, None, "3d", None)], saved.UPDATES)
    row = saved.social_updates(updates, 1_000_000).first()
    assert (row["title"], row["author"], row["created_ts"]) == ("Post by Ann", "Ann — Boss", 1_000_000 - 3 * 86400)


def test_job_statuses(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"status": "failed", "message": "m"}, indent=1))
    found = saved.job_statuses(spark, {"youtube": str(tmp_path / "none.json"), "email": str(tmp_path / "a.json")}).collect()
    assert [(r["job"], r["status"], r["ok"]) for r in found] == [("email", "failed", False), ("youtube", "idle", True)]


def test_stream_appends_each_key_once(spark, tmp_path):
    for n, ids in enumerate(([1, 2, 2], [2, 3])):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in.parquet"))
        stream = ingest.stream_table(spark, str(tmp_path), "in")
        ingest.append_unseen(stream, "id", str(tmp_path / "log"), str(tmp_path / "state"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "log/*")).collect()) == [1, 2, 3]
    once = ingest.run_once(ingest.counts(ingest.stream_table(spark, str(tmp_path), "in", 1), "id"), "complete")
    assert {r["id"]: r["n"] for r in once.collect()} == {1: 1, 2: 3, 3: 1}
    assert F.lit(1) is not None


def test_runs_of_ingestion_give_what_one_run_gives(spark, vectors):
    """Two runs, the second with the leaders and stories of the first, against all items in one run."""
    df, _ = vectors
    items = df.withColumns(
        {"title": F.concat(F.lit("t"), "id"), "summary": F.lit("s"), "sender": F.lit("x"), "gmail_url": F.lit(""), "date": F.lit("d"), "source_type": F.lit("email"), "given": F.col("vector")}
    ).drop("vector")
    check = lambda told, title, summary: (int(title[1:]) % 2 == 1, title, "")
    stories = spark.createDataFrame(
        [], "story_id long, title string, summary string, mention_count long, new_info_count long, is_read boolean, first_seen long, last_updated long"
    )
    embed = lambda _: F.col("given")
    nothing = df.limit(0)
    whole = clusters.persist_stories(items, stories, nothing, embed, check, 5)
    first = clusters.persist_stories(items.where("id < 25"), stories, nothing, embed, check, 5)
    second = clusters.persist_stories(items.where("id >= 25"), first["stories"].withColumn("is_read", F.lit(True)), first["vectors"], embed, check, 5)
    rows = lambda df, *drop: sorted(map(repr, df.drop(*drop).collect()))
    assert rows(second["stories"], "is_read") == rows(whole["stories"], "is_read")
    assert rows(second["vectors"].select("id")) == rows(whole["vectors"].select("id"))
    for part in ("mentions", "timeline", "outcomes"):
        assert rows(first[part].unionByName(second[part])) == rows(whole[part])
    evolved = {r["story_id"] for r in second["timeline"].collect()}
    assert evolved and all(r["is_read"] == (r["story_id"] not in evolved and r["story_id"] < 25) for r in second["stories"].collect())
