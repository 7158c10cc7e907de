"""Queries of the feed, its filter language, facets and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import graph, state
from storyloom.plans import feed, views
from storyloom.plans.views import NOW, SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_OUT = """id, source_type, sort_ts, last_updated, age_days, mention_count, new_info_count, is_read, skipped, source_rank, senders,
  distinct_sender_count, distinct_source_types, score"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.base(
        views.stories(spark, sf_dir), views.mentions(spark, sf_dir), views.bookmarks(spark, sf_dir), views.item_state(spark, sf_dir), NOW
    )


def shown(rows: DataFrame) -> DataFrame:
    """The feed's columns with lists as text and the score rounded, for comparison."""
    return rows.select(
        "id", "source_type", "sort_ts", "last_updated", "age_days", "mention_count", "new_info_count", "is_read", "skipped", "source_rank",
        F.array_join("senders", "|").alias("senders"), F.col("distinct_sender_count").cast("long").alias("distinct_sender_count"),
        F.array_join("distinct_source_types", "|").alias("distinct_source_types"), F.round("score", 6).alias("score"),
    )


def _register(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, SQL + sql


def _feed(sort: str, q: str = "", state: str = "all", source: str = "all") -> Query:
    return lambda spark, sf_dir: shown(feed.ordered(feed.filtered(base(spark, sf_dir), q, state, source), sort, NOW))


for _sort in ("recent", "score", "mentions", "evolved", "oldest"):
    _register(f"feed_{_sort}", _feed(_sort, state="unread"), f"SELECT {_OUT} FROM scored WHERE NOT skipped AND NOT is_read")
for _state, _where in (("unread", "NOT skipped AND NOT is_read"), ("read", "NOT skipped AND is_read"), ("skipped", "skipped")):
    _register(f"state_{_state}", _feed("recent", state=_state), f"SELECT {_OUT} FROM scored WHERE {_where}")


def _second_page(sort: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = graph.cut(feed.filtered(base(spark, sf_dir), state="unread"))
        first = feed.page(rows, sort, NOW, 20).collect()  # a page
        return shown(feed.page(rows, sort, NOW, 20, first[-1] if len(first) == 20 else None).limit(0 if len(first) < 20 else 20))

    return query


_ORDERS = {"recent": "sort_ts DESC, source_rank, last_updated DESC, id", "score": "score DESC, sort_ts DESC, source_rank, last_updated DESC, id"}
_ORDERS |= {"oldest": "sort_ts, source_rank, last_updated, id", "mentions": "mention_count DESC, sort_ts DESC, source_rank, last_updated DESC, id"}
for _sort, _keys in _ORDERS.items():
    _register(f"feed_page_2_{_sort}", _second_page(_sort), f"SELECT {_OUT} FROM scored WHERE NOT skipped AND NOT is_read ORDER BY {_keys} LIMIT 20 OFFSET 20")
_register("source_filter", _feed("recent", source="telegram"), f"SELECT {_OUT} FROM scored WHERE NOT skipped AND source_type = 'telegram'")
_register("source_filter_unknown", _feed("recent", source="nowhere"), f"SELECT {_OUT} FROM scored WHERE NOT skipped")
_register("skip_rule_query", _feed("recent", q="-is:skipped"), f"SELECT {_OUT} FROM scored WHERE NOT skipped")


def _word(value: str) -> str:
    pattern = rf"(^|[^a-z0-9]){value}([^a-z0-9]|$)"
    return f"(regexp_matches(lower(title), '{pattern}') OR regexp_matches(lower(summary), '{pattern}'))"


for _name, _q, _where in (
    ("word", "the", _word("the")),
    ("phrase", '"of the"', _word("of the")),
    ("neg", "-and", f"NOT {_word('and')}"),
    ("sender", "sender:click", "len(list_filter(all_senders, lambda s: contains(s, 'click'))) > 0"),
    ("source", "source:youtube", "source_type = 'youtube'"),
    ("site", "site:src1", "contains(lower(primary_url_host), 'src1')"),
    ("is", "is:read", "is_read"),
    ("is_bogus", "-is:bogus", "true"),
    ("age", "age:>2w", "age_days > 14"),
    ("age_invalid", "-age:1week", "true"),
    ("unknown_op", "foo:tion", "(contains(lower(title), 'tion') OR contains(lower(summary), 'tion'))"),
    ("combo", 'the -source:email age:<=1mo is:unread', f"{_word('the')} AND source_type <> 'email' AND age_days <= 30 AND NOT is_read"),
):
    _register(f"q_{_name}", _feed("recent", q=_q), f"SELECT {_OUT} FROM scored WHERE NOT skipped AND {_where}")
_register("q_skipped", _feed("recent", q="is:skipped"), f"SELECT {_OUT} FROM scored WHERE skipped")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.kinds(views.stories(spark, sf_dir), views.bookmarks(spark, sf_dir), views.item_state(spark, sf_dir))


_register("facets", lambda s, d: feed.facets(_kinds(s, d)), "SELECT source_type, count(*) AS n FROM feed WHERE NOT skipped GROUP BY source_type")
_register(
    "total_unskipped", lambda s, d: feed.facets(_kinds(s, d)).agg(F.sum("n").alias("n")), "SELECT count(*)::BIGINT AS n FROM feed WHERE NOT skipped"
)
_register(
    "search_index", lambda s, d: feed.search_index(views.stories(s, d), views.bookmarks(s, d), views.item_state(s, d), NOW),
    """SELECT id, title, substr(summary, 1, 140) AS summary, source_type FROM (SELECT * FROM stories ORDER BY last_updated DESC, id DESC LIMIT 2000)
    UNION ALL SELECT id, title, substr(excerpt, 1, 140), source FROM bookmarks""",
)
_register(
    "stats", lambda s, d: feed.stats(views.stories(s, d), views.mentions(s, d), NOW),
    f"""SELECT count(*) AS stories, count_if(new_info_count > 0)::BIGINT AS evolved, count_if(NOT is_read AND last_updated > {NOW - 30 * 86400})::BIGINT AS unread_30_days,
    (SELECT count(*) FROM mentions) AS mentions FROM stories""",
)


def _mention_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feed.mention_aggregate(views.mentions(spark, sf_dir))
    return found.select(
        "story_id", F.array_join("senders", "|").alias("senders"), F.col("distinct_sender_count").cast("long").alias("n_senders"),
        F.array_join("source_types", "|").alias("source_types"), "latest_mention_ts",
    )


_register(
    "mention_agg", _mention_agg,
    """SELECT story_id, senders, n_senders, source_types, latest AS latest_mention_ts FROM mention_agg JOIN sender_agg USING (story_id)""",
)
_register(
    "story_counters",
    lambda s, d: state.story_counters(
        views.mentions(s, d).withColumn("created_at", F.col("date_ts")), views.mentions(s, d).where("added_new_info").select("story_id")
    ),
    """SELECT story_id, count(*) AS mention_count, min(date_ts) AS first_seen, max(date_ts) AS last_updated,
    count_if(coalesce(added_new_info, false))::BIGINT AS new_info_count FROM mentions GROUP BY story_id""",
)
_register(
    "evolve_candidates", lambda s, d: state.evolve_candidates(views.mentions(s, d)).select("id", "story_id"),
    "SELECT id, story_id FROM (SELECT id, story_id, row_number() OVER (PARTITION BY story_id ORDER BY id) AS k FROM mentions) WHERE k >= 3",
)
_register(
    "upsert_social", lambda s, d: state.bookmark_snapshots(views.snapshots(s, d).drop("source_rank")),
    """SELECT id, arg_max(title, seen_seq) AS title, arg_min(url, seen_seq) AS url, min(seen_at) AS scraped_at, max(seen_at) AS last_seen_at,
    coalesce(arg_max(created_ts, seen_seq) FILTER (WHERE created_ts > 0), 0)::BIGINT AS created_ts FROM snapshots GROUP BY id""",
)
_register(
    "upsert_playlist", lambda s, d: state.playlist_snapshots(views.snapshots(s, d)),
    """SELECT id, arg_max(title, seen_seq) AS title, arg_max(source_rank, seen_seq) AS source_rank, arg_min(url, seen_seq) AS url, min(seen_at) AS scraped_at,
    max(seen_at) AS last_seen_at,
    (min(seen_at) - greatest(coalesce(arg_min(source_rank, seen_seq) FILTER (WHERE source_rank > 1), 1) - 1, 0))::BIGINT AS created_ts FROM snapshots GROUP BY id""",
)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.snapshots(spark, sf_dir).selectExpr(
        "id", "seen_seq", "CASE seen_seq % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS is_read", "CASE seen_seq % 6 WHEN 0 THEN 1 WHEN 3 THEN 0 END AS skipped"
    )
    return state.latest_flags(log, "id", ("is_read", "skipped"), "seen_seq")


_register(
    "flags_last_write", _flags,
    """SELECT id, coalesce(arg_max(CASE seen_seq % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END, seen_seq) FILTER (WHERE seen_seq % 4 < 2), 0) AS is_read,
    coalesce(arg_max(CASE seen_seq % 6 WHEN 0 THEN 1 WHEN 3 THEN 0 END, seen_seq) FILTER (WHERE seen_seq % 6 IN (0, 3)), 0) AS skipped
    FROM snapshots GROUP BY id""",
)
_register(
    "anti_seen", lambda s, d: state.unseen(views.bookmarks(s, d), views.item_state(s, d), "id").select("id"),
    "SELECT id FROM bookmarks WHERE NOT EXISTS (SELECT 1 FROM flags WHERE flags.id = bookmarks.id)",
)
_register(
    "semi_known", lambda s, d: views.stories(s, d).join(views.item_state(s, d), "id", "left_semi").select("id"),
    "SELECT id FROM stories WHERE EXISTS (SELECT 1 FROM flags WHERE flags.id = stories.id)",
)
_register(
    "bookmark_state", lambda s, d: feed.with_state(views.bookmarks(s, d), views.item_state(s, d)).select("id", "is_read", "skipped"),
    "SELECT id, coalesce(is_read, false) AS is_read, coalesce(skipped, false) AS skipped FROM bookmarks LEFT JOIN flags USING (id)",
)
