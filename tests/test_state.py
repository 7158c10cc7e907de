"""Folds of logs against a loop over the same log."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from storyloom.operators import state


def test_playlist_fold_is_the_sequential_upsert(spark):
    rng, log, wanted = random.Random(3), [], {}
    for seq in range(600):
        key, now, rank = f"youtube:{rng.randrange(60)}", 1000 + seq, rng.choice([None, 0, 1, 1, 2, 5])
        log.append((key, seq, now, f"t{seq}", rank))
        if key not in wanted:
            wanted[key] = {"scraped": now, "created": now - max((rank or 0) - 1, 0)}
        elif wanted[key]["created"] == wanted[key]["scraped"]:
            wanted[key]["created"] = wanted[key]["scraped"] - max((1 if rank is None else rank) - 1, 0)
        wanted[key] |= {"title": f"t{seq}", "rank": rank, "last": now}
    df = spark.createDataFrame(log, "id string, seen_seq long, seen_at long, title string, source_rank long")
    found = {r["id"]: r for r in state.playlist_snapshots(df).collect()}
    assert {k: (r["created_ts"], r["title"], r["source_rank"], r["last_seen_at"]) for k, r in found.items()} == {
        k: (w["created"], w["title"], w["rank"], w["last"]) for k, w in wanted.items()
    }


def test_social_fold_is_the_sequential_upsert(spark):
    rng, log, wanted = random.Random(4), [], {}
    for seq in range(500):
        key, now, created, reply = f"x:{rng.randrange(50)}", 1000 + seq, rng.choice([0, 0, 7, 9]), rng.choice([None, "a"])
        log.append((key, seq, now, f"u{seq}", f"t{seq}", reply, created))
        row = wanted.setdefault(key, {"url": f"u{seq}", "scraped": now, "created": 0})
        row |= {"title": f"t{seq}", "reply": reply, "last": now, "created": created if created > 0 else row["created"]}
    df = spark.createDataFrame(log, "id string, seen_seq long, seen_at long, url string, title string, reply_to string, created_ts long")
    found = {r["id"]: (r["url"], r["scraped_at"], r["created_ts"], r["title"], r["reply_to"], r["last_seen_at"]) for r in state.bookmark_snapshots(df).collect()}
    assert found == {k: (w["url"], w["scraped"], w["created"], w["title"], w["reply"], w["last"]) for k, w in wanted.items()}


def test_hash_dedup_with_retries_and_batches(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", "a", "b", "c", None]), rng.random() < 0.5) for i in range(60)]
    seen, wanted = set(), {}
    for i, h, ok in rows:
        if not h:
            wanted[i] = "empty"
        elif h in seen:
            wanted[i] = "duplicate"
        elif ok:
            wanted[i] = "new"
            seen.add(h)
        else:
            wanted[i] = "retry"
    df = spark.createDataFrame(rows, "id long, hash string, ok boolean")
    found = {r["id"]: r["status"] for r in state.first_by_hash(df, "hash", ["id"], ok=F.col("ok")).collect()}
    assert found == wanted
    # In two batches: what is new in the first is known to the second.
    first = state.first_by_hash(df.where("id < 30"), "hash", ["id"], ok=F.col("ok"))
    known = first.where("status = 'new'").select("hash")
    second = state.first_by_hash(df.where("id >= 30"), "hash", ["id"], known=known, ok=F.col("ok"))
    assert {r["id"]: r["status"] for r in first.unionByName(second).collect()} == wanted


def test_seen_sets(spark):
    items = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    seen = spark.createDataFrame([("a",)], "id string")
    assert [r["id"] for r in state.mark_seen(seen, items, "id").collect()] == ["b"]


def test_a_third_of_all_rows_on_one_hash_or_story(spark):
    rows = [(i, "hot" if i % 3 == 0 else "" if i % 3 == 1 else f"h{i % 40}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, h string")
    known = spark.createDataFrame([("h5",), ("h5",), ("none",)], "h string")
    firsts = {h: min(i for i, x in rows if x == h) for _, h in rows}
    wanted = {i: "empty" if not h else "duplicate" if h == "h5" else "new" if firsts[h] == i else "duplicate" for i, h in rows}
    assert {r["id"]: r["status"] for r in state.first_by_hash(df, "h", ["id"], known).collect()} == wanted
    asked = {r["id"] for r in state.evolve_candidates(df, "h", "id").collect()}
    seen, later = {}, set()
    for i, h in rows:
        seen[h] = seen.get(h, 0) + 1
        if seen[h] > 2:
            later.add(i)
    assert asked == later
