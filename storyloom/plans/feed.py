"""The story feed: stories with their mentions, saved items, filters, facets, scores and orders.

The plan is lazy: the newest stories (a top-k that is part of the feed's meaning), one aggregate of mentions,
one union, one predicate. Facets are an aggregate of the same base before any filter of the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from storyloom.functions.text import BLANKS, normalize_lines, source_label, unescape_html
from storyloom.functions.times import age_days, freshness, iso_from_ts, relative_label
from storyloom.functions.urls import host_of, links_from_json
from storyloom.plans.query_language import compile_clauses, parse, wants_skipped
from storyloom.plans.search_index import SearchIndex

NEWEST = 2000
SHAPE = (
    "id", "title", "summary", "primary_url", "primary_url_host", "primary_image_url", "source_type", "mention_count", "new_info_count",
    "is_read", "skipped", "first_seen", "last_updated", "sort_ts", "age_days", "source_rank", "all_senders", "senders",
    "distinct_sender_count", "distinct_source_types", "source_label", "links", "last_updated_display", "last_updated_relative", "first_seen_relative",
)
LINKS = "array<struct<url: string, host: string>>"


def or_else(*columns: str | Column) -> Column:
    """The first that is neither null, nor empty text; for numbers use ``nonzero``."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def nonzero(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in columns])


def mention_aggregate(mentions: DataFrame) -> DataFrame:
    """(story_id, all_senders, senders, distinct_sender_count, source_types, latest_mention_ts).

    Senders come in the order of their first mention, each once whatever its case, in its first spelling. A
    sender is first summed per story, so what is collected is distinct spellings, not mentions.
    """
    rows = mentions.select(
        "story_id", "id", F.coalesce("sender", F.lit("")).alias("sender"), F.btrim(F.lower(or_else("source_type", F.lit("email")))).alias("source_type"), "date_ts"
    )
    spelled = rows.groupBy("story_id", "sender").agg(F.min("id").alias("first_id"), F.max("date_ts").alias("latest"))
    entry = F.struct("first_id", "sender")
    spelled = spelled.withColumn("key", F.lower(F.btrim("sender")))
    folded = spelled.groupBy("story_id", "key").agg(F.min(entry).alias("first"), F.collect_list(entry).alias("spellings"), F.max("latest").alias("latest"))
    named = F.array_sort(F.collect_list(F.when(F.col("key") != "", F.col("first"))))
    senders = folded.groupBy("story_id").agg(
        F.transform(F.array_sort(F.flatten(F.collect_list("spellings"))), lambda x: x["sender"]).alias("all_senders"),
        F.transform(named, lambda x: F.btrim(x["sender"])).alias("senders"), F.max("latest").alias("latest_mention_ts"),
    )
    kinds = rows.select("story_id", "source_type").distinct().groupBy("story_id").agg(F.array_sort(F.collect_list("source_type")).alias("source_types"))
    return senders.join(kinds, "story_id").withColumn("distinct_sender_count", F.size("senders"))


def story_rows(stories: DataFrame, mentions: DataFrame, now: int, newest: int = NEWEST) -> DataFrame:
    """The newest stories with what their mentions tell; a mail story's time is that of its latest mention.

    Only mentions of these stories are summed: their ids, ``newest`` at most, are broadcast.
    """
    first = [F.desc("last_updated"), F.desc("id")]
    top = stories.orderBy(*first).limit(newest)
    ids = stories.select("id", "last_updated").orderBy(*first).limit(newest).select(F.col("id").alias("story_id"))
    told = mention_aggregate(mentions.join(F.broadcast(ids), "story_id", "left_semi"))
    joined = top.join(told.withColumnRenamed("story_id", "id"), "id", "left")
    raw_links = F.col("links_json") if "links_json" in stories.columns else F.lit(None).cast("string")
    kind = F.btrim(F.lower(or_else("source_type", F.lit("email"))))
    ts = F.when((kind == "email") & F.col("latest_mention_ts").isNotNull(), F.col("latest_mention_ts")).otherwise(F.col("last_updated"))
    none = F.array().cast("array<string>")
    return joined.select(
        "id", "title", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("primary_url", F.lit("")).alias("primary_url"),
        F.coalesce("primary_url_host", F.lit("")).alias("primary_url_host"), F.coalesce("primary_image_url", F.lit("")).alias("primary_image_url"),
        kind.alias("source_type"), F.coalesce("mention_count", F.lit(0)).cast("long").alias("mention_count"),
        F.coalesce("new_info_count", F.lit(0)).cast("long").alias("new_info_count"), F.coalesce("is_read", F.lit(False)).alias("is_read"),
        F.coalesce("skipped", F.lit(False)).alias("skipped"), "first_seen", "last_updated", ts.alias("sort_ts"),
        age_days(ts, now).alias("age_days"), F.lit(0).cast("long").alias("source_rank"), F.coalesce("all_senders", none).alias("all_senders"),
        F.coalesce("senders", none).alias("senders"), F.coalesce("distinct_sender_count", F.lit(0)).alias("distinct_sender_count"),
        F.coalesce("source_types", F.array(kind)).alias("distinct_source_types"), *_shown(kind, ts, F.col("first_seen"), now),
        links_from_json(raw_links).cast(LINKS).alias("links"),
    )


def _shown(kind: Column, ts: Column, first_seen: Column, now: int) -> list[Column]:
    """The source's label and times as they are displayed."""
    return [
        source_label(kind).alias("source_label"), iso_from_ts(ts).alias("last_updated_display"), relative_label(ts, now).alias("last_updated_relative"),
        relative_label(first_seen, now).alias("first_seen_relative"),
    ]


def with_state(bookmarks: DataFrame, state: DataFrame) -> DataFrame:
    """Saved items with their read and skip flags; false where nothing was said."""
    flags = state.select("id", "is_read", "skipped")
    joined = bookmarks.join(flags, "id", "left")
    return joined.withColumns({f: F.coalesce(F.col(f).cast("boolean"), F.lit(False)) for f in ("is_read", "skipped")})


def saved_rows(bookmarks: DataFrame, state: DataFrame, now: int) -> DataFrame:
    """Saved items in the shape of stories; zero times count as missing."""
    created = F.coalesce(nonzero("created_ts", "last_seen_at", "scraped_at"), F.lit(0))
    saved = F.coalesce(nonzero("scraped_at", "last_seen_at", "created_ts"), created)
    source, url = or_else("source", F.lit("external")), F.coalesce("url", F.lit(""))
    sender = F.array(or_else("author", source))
    card = F.nullif(F.get_json_object("link_card_json", "$.url"), F.lit("")) if "link_card_json" in bookmarks.columns else F.lit(None).cast("string")
    links = F.when(card.isNotNull(), F.array(F.struct(card.alias("url"), host_of(card).alias("host")))).otherwise(F.array()).cast(LINKS)
    return with_state(bookmarks, state).select(
        "id", or_else("title", "url", F.lit("(untitled)")).alias("title"), F.coalesce("excerpt", F.lit("")).alias("summary"),
        url.alias("primary_url"), host_of(url).alias("primary_url_host"), F.coalesce("cover", F.lit("")).alias("primary_image_url"),
        source.alias("source_type"), F.lit(1).cast("long").alias("mention_count"), F.lit(0).cast("long").alias("new_info_count"), "is_read", "skipped",
        created.alias("first_seen"), saved.alias("last_updated"), saved.alias("sort_ts"), age_days(saved, now).alias("age_days"),
        F.coalesce("source_rank", F.lit(0)).cast("long").alias("source_rank"), sender.alias("all_senders"), sender.alias("senders"),
        F.lit(1).alias("distinct_sender_count"), F.array(source).alias("distinct_source_types"), *_shown(source, saved, created, now), links.alias("links"),
    )


def base(stories: DataFrame, mentions: DataFrame, bookmarks: DataFrame, state: DataFrame, now: int, newest: int = NEWEST) -> DataFrame:
    """All rows of the feed before any filter."""
    return story_rows(stories, mentions, now, newest).unionByName(saved_rows(bookmarks, state, now))


def score(now: int) -> Column:
    """Mentions, senders, kinds of sources, news, picture and link, fading with age; repetition counts against it."""
    mentions = F.greatest(F.col("mention_count"), F.lit(1))
    senders = F.greatest(F.col("distinct_sender_count"), F.lit(1))
    kinds = F.greatest(F.size("distinct_source_types"), F.lit(1))
    news = F.greatest(F.col("new_info_count"), F.lit(0))
    has = lambda c, points: F.when(F.col(c) != "", F.lit(points)).otherwise(F.lit(0.0))
    # The weights of the score.
    strength = 2.6 * F.log1p(mentions) + 1.2 * F.log1p(senders) + 2.4 * (kinds - 1) + 1.8 * news
    strength = strength + has("primary_image_url", 0.35) + has("primary_url", 0.3)
    return strength * freshness(F.col("last_updated"), now) - 0.55 * F.greatest(mentions - senders, F.lit(0))


def kinds(stories: DataFrame, bookmarks: DataFrame, state: DataFrame, newest: int = NEWEST) -> DataFrame:
    """(source_type, skipped) of all rows of the feed: what facets count, without mentions and texts."""
    top = stories.orderBy(F.desc("last_updated"), F.desc("id")).limit(newest)
    told = top.select(F.btrim(F.lower(or_else("source_type", F.lit("email")))).alias("source_type"), F.coalesce("skipped", F.lit(False)).alias("skipped"))
    return told.unionByName(with_state(bookmarks, state).select(or_else("source", F.lit("external")).alias("source_type"), "skipped"))


def facets(rows: DataFrame) -> DataFrame:
    """(source_type, n) of the rows that aren't skipped, most first."""
    counted = rows.where(~F.col("skipped")).groupBy("source_type").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "source_type")


def filtered(rows: DataFrame, q: str = "", state: str = "all", source: str = "all", index: SearchIndex | None = None) -> DataFrame:
    """The rows that a request asks for; with an index of their words, texts are read where it finds something.

    A source without a visible row counts as all sources. Skipped rows are hidden unless a clause speaks of
    them or the state asks for them.
    """
    if source != "all" and rows.where((F.col("source_type") == source) & ~F.col("skipped")).limit(1).count():
        rows = rows.where(F.col("source_type") == source)
    clauses = parse(q)
    if state != "skipped" and not wants_skipped(clauses):
        rows = rows.where(~F.col("skipped"))
    rows = rows.where(compile_clauses(clauses)) if index is None else index.matching(rows, clauses)
    wanted = {"unread": ~F.col("is_read"), "read": F.col("is_read"), "skipped": F.col("skipped")}.get(state)
    return rows if wanted is None else rows.where(wanted)


def _order(sort: str) -> list[tuple[Column, bool]]:
    """(key, descending) of one of the feed's orders, from a score column; unknown orders are ``recent``. Ties go by id."""
    recent = [(F.coalesce("sort_ts", F.lit(0)), True), (-F.col("source_rank"), True), (F.col("last_updated"), True)]
    if sort == "oldest":
        return [(F.coalesce("sort_ts", F.lit(0)), False), (F.col("source_rank"), False), (F.col("last_updated"), False), (F.col("id"), False)]
    first = {"score": "score", "mentions": "mention_count", "evolved": "new_info_count"}
    return [*([(F.col(first[sort]), True)] if sort in first else []), *recent, (F.col("id"), False)]


def ordered(rows: DataFrame, sort: str = "recent", now: int = 0) -> DataFrame:
    """The rows in one of the feed's orders; ``score`` is added; unknown orders are ``recent``. Ties go by id."""
    return rows.withColumn("score", score(now)).orderBy(*[key.desc() if down else key.asc() for key, down in _order(sort)])


def page(rows: DataFrame, sort: str = "recent", now: int = 0, size: int = 50, after: Row | None = None) -> DataFrame:
    """The first ``size`` rows of an order, or those behind a row of an earlier page, which has to be given with all its columns.

    What stands before is left out by a predicate on the order's keys, so any page is one top-k and no sort of all rows.
    Pages put together are the whole order, rows of equal keys too. Null times come last where the order descends, else first.
    """
    rows = rows.withColumn("score", score(now))
    keys = _order(sort)
    if after is not None:
        given = rows.sparkSession.createDataFrame([after], rows.schema).select(*[key.alias(f"k{n}") for n, (key, _) in enumerate(keys)]).first()
        same, behind = F.lit(True), F.lit(False)
        for (key, down), value in zip(keys, given, strict=True):
            if value is None:
                later = F.lit(False) if down else key.isNotNull()
            else:
                later = (key < F.lit(value)) | key.isNull() if down else key > F.lit(value)
            behind = behind | (same & F.coalesce(later, F.lit(False)))
            same = same & key.eqNullSafe(F.lit(value))
        rows = rows.where(behind)
    return rows.orderBy(*[key.desc() if down else key.asc() for key, down in keys]).limit(size)


def search_index(stories: DataFrame, bookmarks: DataFrame, state: DataFrame, now: int, newest: int = NEWEST) -> DataFrame:
    """(id, title, summary, source_type): the newest stories and all saved items, summaries cut to 140."""
    top = stories.orderBy(F.desc("last_updated"), F.desc("id")).limit(newest).select("id", "title", "summary", "source_type")
    both = top.unionByName(saved_rows(bookmarks, state, now).select("id", "title", "summary", "source_type"))
    return both.withColumn("summary", F.substring(F.coalesce("summary", F.lit("")), 1, 140))


def stats(stories: DataFrame, mentions: DataFrame, now: int) -> DataFrame:
    """One row: stories, mentions, unread ones of the last 30 days, stories with news."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    unread = ~F.coalesce("is_read", F.lit(False)) & (F.col("last_updated") > now - 30 * 86400)
    of_stories = stories.select(
        one.alias("stories"), none.alias("mentions"), (F.col("new_info_count") > 0).cast("long").alias("evolved"), unread.cast("long").alias("unread_30_days")
    )
    of_mentions = mentions.select(none.alias("stories"), one.alias("mentions"), none.alias("evolved"), none.alias("unread_30_days"))
    both = of_stories.unionByName(of_mentions)
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns])


def rendered_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions as they are shown: of mails the raw title and body, else the stored ones, normalised.

    A body that begins with the title and goes on with a letter or digit gets an empty line after the title.
    """
    is_mail = or_else("source_type", F.lit("email")) == "email"
    shown = lambda *names: normalize_lines(unescape_html(F.coalesce(or_else(*names), F.lit(""))))
    rows = mentions.withColumns({"_title": shown("raw_title", "title"), "_body": shown("raw_body", "summary")})
    rest = F.substring("_body", F.length("_title") + 1, F.length("_body"))
    runs_on = (F.col("_title") != "") & F.startswith("_body", "_title") & rest.rlike(r"^[\p{L}\p{N}]")
    body = F.when(runs_on, F.concat("_title", F.lit("\n\n"), F.ltrim(rest, F.lit(BLANKS)))).otherwise(F.col("_body"))
    told = {"title": F.when(is_mail, F.col("_title")).otherwise(F.col("title")), "summary": F.when(is_mail, body).otherwise(F.col("summary"))}
    return rows.withColumns(told).drop("_title", "_body")


def saved_mentions(rows: DataFrame) -> DataFrame:
    """The one made-up mention of each saved item, from ``saved_rows``."""
    date = nonzero("first_seen", "last_updated")
    return rows.select(
        F.col("id").alias("story_id"), "title", "summary", F.get("senders", F.lit(0)).alias("sender"), F.col("primary_url").alias("gmail_url"),
        F.coalesce(date, F.lit(0)).alias("date_ts"), "source_type",
    )


def story_detail(
    story_id, stories: DataFrame, mentions: DataFrame, timeline: DataFrame, bookmarks: DataFrame | None = None, state: DataFrame | None = None, now: int = 0,  # noqa: ANN001
) -> dict[str, DataFrame]:
    """A story, its mentions and its timeline, newest first; reading it changes nothing.

    With ``bookmarks`` and their ``state`` an id that is no story's is looked up there; its mention is made up and
    its timeline is empty.
    """
    newest = lambda df: df.where(F.col("story_id") == story_id).orderBy(F.desc("date_ts"), F.desc("id"))
    own = stories.where(F.col("id") == story_id)
    if bookmarks is None or own.limit(1).count():
        return {"story": own, "mentions": newest(rendered_mentions(mentions) if "raw_title" in mentions.columns else mentions), "timeline": newest(timeline)}
    saved = saved_rows(bookmarks.where(F.col("id") == story_id), state.where(F.col("id") == story_id), now)
    return {"story": saved, "mentions": saved_mentions(saved), "timeline": timeline.limit(0)}
