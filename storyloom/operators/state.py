"""State as folds over append-only logs: counters, flags, upserts, seen-sets and first-wins dedup.

Every mutable value is an aggregate with a partial form, so a log is read once and summed map-side; nothing is
merged in place and a rerun over the same log gives the same state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import message_id
from storyloom.operators.graph import cut
from storyloom.operators.joins import join_counted

# What a later snapshot of a bookmark overwrites; url, source, scraped_at and tags stay.
OVERWRITTEN = ("title", "excerpt", "cover", "author", "avatar", "media_json", "quoted_json", "reply_to", "link_card_json")


def unseen(items: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The items whose key is not among the seen ones."""
    return items.join(seen.select(key).distinct(), key, "left_anti")


def mark_seen(seen: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """The keys to append to the seen-set: each new one once."""
    return unseen(items.select(key).where(F.col(key).isNotNull()).distinct(), seen, key)


def latest_flags(log: DataFrame, key: str, flags: tuple[str, ...], order: str) -> DataFrame:
    """Per key and flag the last value that isn't null; 0 if there is none. Flags are independent."""
    last = lambda f: F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(order), F.col(f))))[f]
    return log.groupBy(key).agg(*[F.coalesce(last(f), F.lit(0)).alias(f) for f in flags])


def bookmark_snapshots(log: DataFrame) -> DataFrame:
    """Social bookmarks after all snapshots: the last one's fields, the first one's url and source.

    ``created_ts`` is the last positive one, else 0. The log has id, source, url, seen_seq, seen_at, created_ts
    and any of the overwritten fields.
    """
    fields = [f for f in OVERWRITTEN if f in log.columns]
    kept = [f for f in ("source", "url", "tags") if f in log.columns]
    last = F.max_by(F.struct(*fields), "seen_seq").alias("last")
    known = F.max(F.when(F.col("created_ts") > 0, F.struct("seen_seq", "created_ts")))["created_ts"]
    folded = log.groupBy("id").agg(
        last, *[F.min_by(f, "seen_seq").alias(f) for f in kept], F.coalesce(known, F.lit(0)).alias("created_ts"),
        F.min("seen_at").alias("scraped_at"), F.max("seen_at").alias("last_seen_at"),
    )
    return folded.select("id", *kept, *[F.col(f"last.{f}").alias(f) for f in fields], "created_ts", "scraped_at", "last_seen_at")


def playlist_snapshots(log: DataFrame) -> DataFrame:
    """Playlist entries after all syncs.

    ``created_ts`` is the time first seen less (rank - 1) for the first rank above 1 that was ever seen: until
    then each sync may set it again, and after that it stays.
    """
    fields = [f for f in ("title", "excerpt", "cover", "author", "tags", "source_rank") if f in log.columns]
    kept = [f for f in ("source", "url", "avatar") if f in log.columns]
    ranked = F.min(F.when(F.col("source_rank") > 1, F.struct("seen_seq", "source_rank")))["source_rank"]
    folded = log.groupBy("id").agg(
        F.max_by(F.struct(*fields), "seen_seq").alias("last"), *[F.min_by(f, "seen_seq").alias(f) for f in kept],
        F.min("seen_at").alias("scraped_at"), F.max("seen_at").alias("last_seen_at"), ranked.alias("_rank"),
    )
    created = F.col("scraped_at") - F.greatest(F.coalesce("_rank", F.lit(1)) - 1, F.lit(0))
    return folded.select(
        "id", *kept, *[F.col(f"last.{f}").alias(f) for f in fields], created.alias("created_ts"), "scraped_at", "last_seen_at"
    )


def still_needed(log: DataFrame, key: str, order: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a log of snapshots or flags that the folds above depend on; any fold of them is that of the whole log.

    Of each key: the first and last row, those first and last seen, the last with a positive ``created_ts``, the first
    with a rank above 1, and of each flag the last that isn't null; a key keeps a few rows, however many it had. Folded
    again with later rows it gives what it gives over all rows, so logs can be compacted by it.
    """
    row = F.struct(*log.columns)
    wanted = [F.min_by(row, order), F.max_by(row, order)]
    if "seen_at" in log.columns:
        wanted += [F.min_by(row, F.struct("seen_at", order)), F.max_by(row, F.struct("seen_at", order))]
    if "created_ts" in log.columns:
        wanted.append(F.max_by(row, F.when(F.col("created_ts") > 0, F.col(order))))
    if "source_rank" in log.columns:
        wanted.append(F.min_by(row, F.when(F.col("source_rank") > 1, F.col(order))))
    wanted += [F.max_by(row, F.when(F.col(f).isNotNull(), F.col(order))) for f in flags]
    kept = log.groupBy(key).agg(F.array_distinct(F.array_compact(F.array(*wanted))).alias("r"))
    return kept.select(F.explode("r").alias("r")).select("r.*")


def outcome_counts(*outcomes: DataFrame) -> DataFrame:
    """(outcome, n) of a run: how many were new, merged, evolved, duplicate, skipped and why."""
    each = reduce(DataFrame.unionByName, [df.select(F.coalesce("outcome", F.lit("unknown")).alias("outcome")) for df in outcomes])
    return each.groupBy("outcome").agg(F.count("*").alias("n"))


def story_counters(mentions: DataFrame, timeline: DataFrame) -> DataFrame:
    """(story_id, mention_count, first_seen, last_updated, new_info_count) from the two logs."""
    counted = mentions.groupBy("story_id").agg(
        F.count("*").alias("mention_count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_updated")
    )
    changes = timeline.groupBy("story_id").agg(F.count("*").alias("new_info_count"))
    return counted.join(changes, "story_id", "left").withColumn("new_info_count", F.coalesce("new_info_count", F.lit(0)))


def first_by_hash(rows: DataFrame, hash_col: str, order: list[str], known: DataFrame | None = None, ok: Column | None = None) -> DataFrame:
    """``rows`` with ``status``: new, duplicate, retry or empty.

    Of equal non-empty hashes the first good row is new and all after it are duplicates; rows before it that
    aren't good (``ok`` false) are to be tried again; hashes in ``known`` are duplicates. The first good row is
    one aggregate per hash, joined back by counts: a hash that a third of all rows share is broadcast, and rows
    without a hash take no part. ``rows`` are read more than once; hand in stored ones if they cost much.
    """
    good = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    marked = rows.withColumns({"_good": good, "_place": F.struct(*order), "_hash": F.nullif(F.col(hash_col), F.lit(""))})
    firsts = marked.where(F.col("_hash").isNotNull()).groupBy("_hash").agg(
        F.min(F.when(F.col("_good"), F.col("_place"))).alias("_first"), F.count("*").alias("n")
    )
    if known is not None:
        firsts = firsts.join(known.select(F.col(hash_col).alias("_hash"), F.lit(True).alias("_known")).distinct(), "_hash", "left")
    else:
        firsts = firsts.withColumn("_known", F.lit(False))
    firsts = cut(firsts)
    hashed = marked.where(F.col("_hash").isNotNull())
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    status = (
        F.when(F.coalesce("_known", F.lit(False)), F.lit("duplicate"))
        .when(F.col("_first").isNull() | (F.col("_place") < F.col("_first")), F.lit("retry"))
        .when(F.col("_place") == F.col("_first"), F.lit("new"))
        .otherwise(F.lit("duplicate"))
    )
    told = join_counted(hashed, firsts, "_hash", total).withColumn("status", status)
    empty = marked.where(F.col("_hash").isNull()).withColumn("status", F.lit("empty"))
    return told.select(*rows.columns, "status").unionByName(empty.select(*rows.columns, "status"))


def evolve_candidates(mentions: DataFrame, key: str = "story_id", order: str = "id") -> DataFrame:
    """Mentions that ask whether the story has news: those with at least two mentions of it before them.

    A story's first and second mention are partial aggregates, so a story that a third of all mentions tell of is
    no single task's sort. Mentions of one story with one order value are one; those without a story ask nothing.
    """
    first = cut(mentions.groupBy(key).agg(F.min(order).alias("_after"), F.count("*").alias("n")))
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    later = join_counted(mentions, first, key, total).where(F.col(order) > F.col("_after"))
    second = cut(later.groupBy(key).agg(F.min(order).alias("_after"), F.count("*").alias("n")))
    return join_counted(mentions, second, key, total).where(F.col(order) > F.col("_after")).drop("_after")


def route_marks(marks: DataFrame, stories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read and skip marks (id, ...) split by where they belong: to stories, and to saved items (all other ids)."""
    known = stories.select("id").distinct()
    return marks.join(known, "id", "left_semi"), marks.join(known, "id", "left_anti")


def hydrate(mentions: DataFrame, messages: DataFrame) -> DataFrame:
    """Mail mentions that lack a raw title or body filled from their messages (id, subject, body).

    The message id is taken from the mention's link. Messages are reduced to the ids asked for before the join,
    each once: of several of one id the first in order of subject and body, so a rerun takes the same.
    """
    asked = F.when(
        (F.coalesce("source_type", F.lit("email")) == "email") & ((F.coalesce("raw_title", F.lit("")) == "") | (F.coalesce("raw_body", F.lit("")) == "")),
        F.nullif(message_id(F.col("gmail_url")), F.lit("")),
    )
    rows = mentions.withColumn("_message", asked)
    wanted = rows.select(F.col("_message").alias("id")).where(F.col("id").isNotNull()).distinct()
    found = messages.select("id", "subject", "body").join(wanted, "id", "left_semi")
    found = found.groupBy(F.col("id").alias("_message")).agg(F.min(F.struct("subject", "body")).alias("t"))
    found = found.select("_message", F.col("t.subject").alias("_subject"), F.col("t.body").alias("_body"))
    filled = rows.join(found, "_message", "left")
    return filled.withColumns(
        {"raw_title": F.coalesce(F.nullif(F.col("raw_title"), F.lit("")), "_subject"), "raw_body": F.coalesce(F.nullif(F.col("raw_body"), F.lit("")), "_body")}
    ).select(*mentions.columns)
