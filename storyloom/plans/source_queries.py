"""Queries of mail, channels, saved items and paged scans; their inputs are made from the synthetic tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import links, text, urls
from storyloom.operators import graph, models, state
from storyloom.plans import feed, views
from storyloom.plans.text_queries import any_sql, clean_sql, score_sql, strip_sql, stub_sql
from storyloom.plans.views import NOW
from storyloom.session import table
from storyloom.sources import channels, mail, saved
from storyloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# --- mail -------------------------------------------------------------------------------------------------------------

_SUBJECT = "CASE doc_id % 6 WHEN 0 THEN 'Re: news' WHEN 1 THEN 'Your receipt' WHEN 2 THEN 'A notice' ELSE 'Weekly ' || lang END"
_SENDER = """CASE doc_id % 4 WHEN 0 THEN 'Bob B <Bob@' || source || '.org>' WHEN 1 THEN 'news@x.substack.com' WHEN 2 THEN 'noreply@shop.com'
  ELSE ' Ann <no-reply@beehiiv.com>' END"""
_STUB = "Read online"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as saved mails: plain, HTML, or both with a plain stub; some without list headers."""
    coded = lambda x: F.rtrim(F.translate(F.base64(F.encode(x, "UTF-8")), "+/", "-_"), F.lit("="))
    part = lambda kind, x: F.struct(F.lit(kind).alias("mimeType"), F.struct(coded(x).alias("data")).alias("body"))
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    rows = _docs(spark, sf_dir).withColumns(
        {
            "subject": F.expr(_SUBJECT), "sender": F.expr(_SENDER),
            "rich": F.concat(
                F.lit("<html><style>p {}</style><p>"), F.replace("text", F.lit("\n"), F.lit("</p><p>")), F.lit("</p><a class='x' href=\"https://a.org/"),
                F.col("doc_id").cast("string"), F.lit('">more</a></html>'),
            ),
        }
    )
    listed = F.when(F.col("doc_id") % 5 == 0, F.array(header("Precedence", F.lit("Bulk")))).when(F.col("doc_id") % 7 != 0, F.array(header("List-Id", F.lit("x"))))
    headers = F.concat(F.array(header("Subject", F.col("subject")), header("FROM", F.col("sender")), header("Date", F.lit("d"))), F.coalesce(listed, F.array()))
    payload = (
        F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(headers.alias("headers"), *_fields(part("text/plain", F.col("text"))))))
        .when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(headers.alias("headers"), *_fields(part("text/html", F.col("rich"))))))
        .otherwise(
            F.to_json(
                F.struct(headers.alias("headers"), F.lit("multipart/alternative").alias("mimeType"), F.array(part("text/plain", F.lit(_STUB)), part("text/html", F.col("rich"))).alias("parts"))
            )
        )
    )
    return rows.select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), F.lit("s").alias("snippet"), payload.alias("payload"))


def _fields(struct: F.Column) -> list[F.Column]:
    return [struct[name].alias(name) for name in ("mimeType", "body")]


def _newsletters(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """All letters, or that of one id, which is looked for before any message is read."""
    mails = messages(spark, sf_dir)
    found = mail.newsletters(mails if only is None else mails.where(F.col("id") == only))
    return found.withColumn("hrefs", F.array_join(F.transform("links", lambda x: F.concat(x["anchor"], F.lit(">"), x["href"])), "|")).drop("links")


def _skip_sql(subject: str, sender: str, listed: str) -> str:
    low, own = f"lower({subject})", f"lower({sender})"
    return f"""({any_sql(own, ('github.com', 'no-reply@accounts.google.com', *text.TRANSACTIONAL))} OR ({any_sql(own, text.AUTOMATIC)}
    AND NOT {any_sql(own, text.NEWSLETTER_SERVICES)}) OR starts_with({low}, 're:') OR starts_with({low}, 'fwd:') OR {any_sql(low, text.SKIPPED_SUBJECTS)}
    OR (NOT {listed} AND {any_sql(low, text.TRANSACTION_HINTS)}))"""


def _normal_sql(x: str) -> str:
    """Mail text as ``normalize_lines`` makes it, but for entities, which the tables have none of."""
    lines = f"string_split(regexp_replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(9), ' '), ' {{2,}}', ' ', 'g'), chr(10))"
    kept = f"list_filter(list_transform({lines}, lambda y: {strip_sql('y')}), lambda y: length(y) < 8 OR regexp_matches(y, '[A-Za-z0-9]'))"
    return strip_sql(f"regexp_replace(array_to_string({kept}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")


_MAILS = f"""m AS (
  SELECT doc_id, text, {_SUBJECT} AS subject, {_SENDER} AS sender, {strip_sql(clean_sql("'<p>' || replace(text, chr(10), '</p><p>') || '</p>more'"))} AS rich FROM documents),
b AS (
  SELECT *, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN rich ELSE
      CASE WHEN (NOT {stub_sql('rich')} AND length(rich) >= {2 * len(_STUB)}) OR {score_sql('rich')} > {len(_STUB) - 2500} THEN rich ELSE '{_STUB}' END END AS raw,
    {_skip_sql('subject', 'sender', '(doc_id % 5 = 0 OR doc_id % 7 <> 0)')} AS skip FROM m),
o AS (
  SELECT *, CASE WHEN skip THEN 'skipped' WHEN length(body) < 50 THEN 'short' ELSE 'ok' END AS outcome
  FROM (SELECT *, {_normal_sql('raw')} AS body FROM b))"""
_LETTER = "'m' || doc_id AS id, subject, sender, 'd' AS date, 's' AS snippet, 'https://mail.google.com/mail/u/0/#inbox/m' || doc_id AS gmail_url"
_LETTERS = f"""SELECT {_LETTER}, CASE WHEN outcome = 'ok' THEN body END AS body, outcome,
  CASE WHEN outcome = 'ok' THEN CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'more>https://a.org/' || doc_id END END AS hrefs FROM o"""
_register("newsletters", _newsletters, f"WITH {_MAILS} {_LETTERS}")
_register("newsletter_by_id", lambda s, d: _newsletters(s, d, "m7"), f"WITH {_MAILS} SELECT * FROM ({_LETTERS}) WHERE id = 'm7'")
_register(
    "mail_outcomes", lambda s, d: state.outcome_counts(mail.newsletters(messages(s, d)), channel_stories(s, d)),
    f"""WITH {_MAILS}, p AS (SELECT CASE WHEN doc_id % 4 > 1 THEN 'dropped' WHEN doc_id % 4 = 0 AND w = '' THEN 'empty' ELSE 'story' END AS outcome
    FROM (SELECT doc_id, trim(substr(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 1, 300)) AS w FROM documents))
    SELECT outcome, count(*) AS n FROM (SELECT outcome FROM o UNION ALL SELECT outcome FROM p) GROUP BY outcome""",
)
_register(
    "sender_parts",
    lambda s, d: _docs(s, d).select("doc_id", F.expr(_SENDER).alias("x")).select(
        "doc_id", text.sender_name(F.col("x")).alias("name"), text.sender_host(F.col("x")).alias("host"),
        text.message_id(F.concat(F.lit("https://mail.google.com/#inbox/"), F.col("doc_id").cast("string"), F.lit(" "))).alias("message"),
        text.decode_base64url(F.rtrim(F.translate(F.base64(F.encode("x", "UTF-8")), "+/", "-_"), F.lit("="))).alias("decoded"),
    ),
    f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Bob B' WHEN 3 THEN 'Ann' ELSE x END AS name, lower(regexp_extract(x, '@([A-Za-z0-9.]+)', 1)) AS host,
    doc_id::VARCHAR AS message, x AS decoded FROM (SELECT doc_id, {_SENDER} AS x FROM documents)""",
)
_register(
    "normalized_text",
    lambda s, d: _docs(s, d).select(
        "doc_id", text.normalize_lines(text.unescape_html(F.concat(F.lit(" ​&amp;\r\n­ \n\n\n-----------\nℏ¬ℏ¬ ℏ¬ℏ¬ ℏ¬ "), F.col("text")))).alias("plain")
    ),
    f"SELECT doc_id, CASE WHEN n = '' THEN '&' ELSE '&' || chr(10) || chr(10) || n END AS plain FROM (SELECT doc_id, {_normal_sql('text')} AS n FROM documents)",
)

# --- channels ---------------------------------------------------------------------------------------------------------

_WORDS = "trim(substr(regexp_replace(text, '[^A-Za-z ]', ''{g}), 1, 300))"


def channel_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with one post for each document."""
    rows = _docs(spark, sf_dir).selectExpr("doc_id", "lang", f"{_WORDS.format(g='')} AS w")
    return rows.selectExpr(
        "lang AS channel",
        """concat('<div class="tgme_widget_message_wrap x"><div><a class="tgme_widget_message_date" href="https://t.me/', lang, '/', doc_id,
        '"><time datetime="2024-01-', lpad(cast(1 + doc_id % 28 AS string), 2, '0'), 'T00:00:00+00:00"></time></a>',
        CASE WHEN doc_id % 3 = 0 THEN '<a class="tgme_widget_message_link_preview" href="https://p.org/"><b>no</b></a>' ELSE '' END,
        '<div class="tgme_widget_message_text"> ', w, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '<br><a href="https://x.org/1">one</a><a href="https://t.me/x">me</a>'
        WHEN 2 THEN '<a href="https://x.org/1?erid=5">one</a><a href="/in">two</a>'
        ELSE '<a href="https://a.org">one</a><a href="https://www.b.org">two</a><a href="https://x.com/c">x</a><a href="https://c.org/d">three</a>' END, '</div>',
        CASE WHEN doc_id % 2 = 0 THEN '<a class="tgme_widget_message_photo_wrap" style="width:1px;background-image:url(''https://img.org/1'')"></a>' ELSE '' END,
        '</div></div>') AS html""",
    )


def channel_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.post_stories(channels.posts(channel_pages(spark, sf_dir), "none"))


_POSTS = f"""p AS (
  SELECT *, CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['https://x.org/1'] WHEN 2 THEN ['https://x.org/1?erid=5']
      ELSE ['https://a.org', 'https://www.b.org', 'https://x.com/c', 'https://c.org/d'] END AS own,
    concat_ws(chr(10), nullif(w, ''), CASE doc_id % 4 WHEN 1 THEN 'one' || chr(10) || 'me' WHEN 2 THEN 'one' || chr(10) || 'two'
      WHEN 3 THEN 'one' || chr(10) || 'two' || chr(10) || 'x' || chr(10) || 'three' END) AS said
  FROM (SELECT doc_id, lang, {_WORDS.format(g=", 'g'")} AS w FROM documents)),
q AS (
  SELECT *, 'tg:' || lang || ':' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN list_concat(['https://p.org/'], own) ELSE own END AS links,
    'https://t.me/' || lang || '/' || doc_id AS url, '2024-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || 'T00:00:00+00:00' AS date FROM p)"""
_HASHED = "substr(trim(regexp_replace(lower(said), '[ \\n]+', ' ', 'g')), 1, 500)"
_register(
    "channel_posts",
    lambda s, d: channels.since(channels.posts(channel_pages(s, d), "none"), NOW - 20 * 86400).select(
        "id", "channel", "msg_id", "url", "date", "text", F.array_join("links", "|").alias("links"), F.array_join("images", "|").alias("images"), "is_sponsored", "is_digest"
    ),
    f"""WITH {_POSTS} SELECT id, lang AS channel, doc_id AS msg_id, url, date, said AS text, array_to_string(links, '|') AS links,
    CASE WHEN doc_id % 2 = 0 THEN 'https://img.org/1' ELSE '' END AS images, doc_id % 4 = 2 AS is_sponsored, doc_id % 4 = 3 AS is_digest
    FROM q WHERE 1 + doc_id % 28 >= 11""",
)
_register(
    "channel_stories", lambda s, d: channel_stories(s, d).withColumn("links", F.array_join("links", "|")),
    f"""WITH {_POSTS} SELECT id, CASE WHEN doc_id % 4 > 1 THEN 'dropped' WHEN said = '' THEN 'empty' ELSE 'story' END AS outcome,
    CASE WHEN said = '' THEN '@' || lang || ' post' ELSE substr(string_split(said, chr(10))[1], 1, 140) END AS title, said AS summary,
    CASE WHEN len(links) > 0 THEN links[1] ELSE url END AS primary_url, '@' || lang AS sender, url, date,
    CASE WHEN doc_id % 2 = 0 THEN 'https://img.org/1' ELSE '' END AS primary_image_url, CASE WHEN said = '' THEN '' ELSE sha1({_HASHED}) END AS content_hash,
    false AS needs_translation, array_to_string(links, '|') AS links FROM q""",
)
_register(
    "post_duplicates",
    lambda s, d: state.first_by_hash(graph.cut(channel_stories(s, d).where("outcome = 'story'").select("id", "content_hash")), "content_hash", ["id"]).select("id", "status"),
    f"""WITH {_POSTS} SELECT id, CASE WHEN row_number() OVER (PARTITION BY {_HASHED} ORDER BY id) = 1 THEN 'new' ELSE 'duplicate' END AS status
    FROM q WHERE doc_id % 4 < 2 AND said <> ''""",
)
_CYRILLIC = "CASE WHEN doc_id % 3 = 0 THEN translate(text, 'aeiounrst', 'аеиоунрст') ELSE text END || ' https://a.org/' || doc_id || '?q=b [[URL7]] http://c.org'"
_register(
    "translated",
    lambda s, d: _docs(s, d).selectExpr("doc_id", f"{_CYRILLIC} AS x").select("doc_id", text.needs_translation(F.col("x")).alias("needed"), models.in_english(F.col("x")).alias("plain")),
    f"""SELECT doc_id, coalesce(c / nullif(c + l, 0) >= 0.15, false) AS needed, CASE WHEN coalesce(c / nullif(c + l, 0) >= 0.15, false) THEN {strip_sql('x')} ELSE x END AS plain
    FROM (SELECT doc_id, x, len(regexp_extract_all(x, '[Ѐ-ӿ]'))::DOUBLE AS c, len(regexp_extract_all(x, '[A-Za-z]')) AS l FROM (SELECT doc_id, {_CYRILLIC} AS x FROM documents))""",
)
_register(
    "masked_links",
    lambda s, d: _docs(s, d).selectExpr("doc_id", f"{_CYRILLIC} AS x").select("doc_id", text.mask_urls(F.col("x")).alias("m"), "x").select(
        "doc_id", F.col("m.masked").alias("masked"), (text.unmask_urls(F.col("m.masked"), F.col("m.urls")) == F.col("x")).alias("same")
    ),
    f"""SELECT doc_id, left(x, length(x) - length(e)) || '[[URL1]] [[URL7]] [[URL2]]' AS masked, true AS same
    FROM (SELECT doc_id, {_CYRILLIC} AS x, 'https://a.org/' || doc_id || '?q=b [[URL7]] http://c.org' AS e FROM documents)""",
)

# --- saved items ------------------------------------------------------------------------------------------------------

_CARD = "named_struct('url', 'https://card.org/' || doc_id, 'domain', 'card.org', 'title', '', 'description', CAST(NULL AS STRING), 'cover', 'https://card.org/c')"


def _social(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).selectExpr(
        "CAST(doc_id AS STRING) AS tid", "CASE WHEN doc_id % 2 = 0 THEN '/u/' || doc_id ELSE 'https://y.org/' || doc_id END AS href",
        "CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS text", "lang AS authorName", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '@' || source END AS handle",
        "'https://p.org/a_normal.jpg' AS avatar", "CAST(NULL AS STRING) AS replyTo", "CASE WHEN doc_id % 4 = 0 THEN 'odd' ELSE '2024-01-02T03:04:05.000Z' END AS dt",
        "CASE WHEN doc_id % 5 = 0 THEN 'An article' END AS articleTitle", "doc_id % 5 = 0 AS isArticle",
        "CASE WHEN doc_id % 3 = 0 THEN array(named_struct('type', 'photo', 'url', ''), named_struct('type', 'photo', 'url', 'https://m.org/1')) END AS media",
        "CAST(NULL AS STRUCT<name: STRING, handle: STRING, text: STRING, cover: STRING>) AS quoted", f"CASE WHEN doc_id % 2 = 1 THEN {_CARD} END AS linkCard",
    )
    return saved.social_posts(rows)


_CARD_SQL = """CASE WHEN doc_id % 2 = 1 THEN '{"url":"https://card.org/' || doc_id || '","domain":"card.org","title":"","cover":"https://card.org/c"}' END AS link_card_json"""
_CUT = "CASE WHEN length({0}) > 200 THEN substr({0}, 1, 200) || '…' ELSE {0} END AS title"
_register(
    "social_posts", _social,
    f"""SELECT 'twitter:' || doc_id AS id, 'twitter' AS source, CASE WHEN doc_id % 2 = 0 THEN 'https://x.com/u/' || doc_id ELSE 'https://y.org/' || doc_id END AS url,
    {_CUT.format('t')}, substr(said, 1, 500) AS excerpt, CASE WHEN doc_id % 3 = 0 THEN 'https://m.org/1' ELSE '' END AS cover,
    trim(lang || ' ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '@' || source END) AS author, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1704164645 END::BIGINT AS created_ts,
    'https://p.org/a_400x400.jpg' AS avatar,
    CASE WHEN doc_id % 3 = 0 THEN '[{{"type":"photo","url":""}},{{"type":"photo","url":"https://m.org/1"}}]' ELSE '[]' END AS media_json, NULL::VARCHAR AS quoted_json, '' AS reply_to,
    {_CARD_SQL} FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'An article' WHEN said <> '' THEN string_split(said, chr(10))[1]
      ELSE 'Tweet by ' || CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE '@' || source END END AS t
      FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS said FROM documents))""",
)


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).selectExpr(
        "CAST(doc_id AS STRING) AS urn", "CASE WHEN doc_id % 2 = 0 THEN 'https://l.org/' || doc_id END AS url", "CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE ' ' || text END AS text",
        "lang AS authorName", "CASE WHEN doc_id % 3 = 0 THEN 'Head of ' || source END AS authorTitle", "CAST(NULL AS STRING) AS authorProfile", "'https://p.org/b' AS avatar",
        "CASE WHEN doc_id % 4 = 0 THEN 'https://c.org/0' END AS cover", "CASE WHEN doc_id % 5 = 0 THEN 'today' ELSE (doc_id % 30) || 'd' END AS ageText",
        f"CASE WHEN doc_id % 2 = 1 THEN {_CARD} END AS linkCard",
    )
    return saved.social_updates(rows, NOW)


_register(
    "social_updates", _updates,
    f"""SELECT 'linkedin:' || doc_id AS id, 'linkedin' AS source, CASE WHEN doc_id % 2 = 0 THEN 'https://l.org/' || doc_id ELSE 'https://www.linkedin.com/feed/update/' || doc_id || '/' END AS url,
    {_CUT.format('t')}, substr(said, 1, 800) AS excerpt, CASE WHEN doc_id % 4 = 0 THEN 'https://c.org/0' WHEN doc_id % 2 = 1 THEN 'https://card.org/c' ELSE '' END AS cover,
    lang || CASE WHEN doc_id % 3 = 0 THEN ' — Head of ' || source ELSE '' END AS author, (CASE WHEN doc_id % 5 = 0 THEN 0 ELSE {NOW} - (doc_id % 30) * 86400 END)::BIGINT AS created_ts,
    'https://p.org/b' AS avatar, '[]' AS media_json, NULL::VARCHAR AS quoted_json, '' AS reply_to, {_CARD_SQL}
    FROM (SELECT *, CASE WHEN said <> '' THEN string_split(said, chr(10))[1] ELSE 'Post by ' || lang END AS t
      FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN '' ELSE {strip_sql('text')} END AS said FROM documents))""",
)


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    thumb = lambda n, w, h: f"named_struct('url', 'https://t.org/{n}', 'width', {w}, 'height', {h})"
    rows = _docs(spark, sf_dir).selectExpr(
        "CASE WHEN doc_id % 13 = 0 THEN '' ELSE CAST(doc_id AS STRING) END AS id", "CASE WHEN doc_id % 2 = 0 THEN 'https://v.org/' || doc_id END AS url",
        "CASE WHEN doc_id % 3 = 0 THEN 'https://w.org/' || doc_id END AS webpage_url", "CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE ' ' || lang END AS title",
        "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS uploader", "CASE WHEN doc_id % 8 = 0 THEN 'ch' END AS channel", "CAST(doc_id % 9 AS INT) AS playlist_index",
        "CASE WHEN doc_id % 6 = 0 THEN 0D ELSE doc_id * 1.5D END AS duration",
        f"CASE WHEN doc_id % 7 = 0 THEN NULL ELSE array({thumb(1, 10, 10)}, {thumb(2, 20, 30)}, {thumb(3, 30, 20)}, {thumb(4, 'CAST(NULL AS INT)', 99)}) END AS thumbnails",
    )
    return saved.playlist_items(rows, NOW)


_register(
    "playlist_items", _videos,
    f"""SELECT 'youtube:' || doc_id AS id, 'youtube' AS source, CASE WHEN doc_id % 2 = 0 THEN 'https://v.org/' || doc_id WHEN doc_id % 3 = 0 THEN 'https://w.org/' || doc_id
      ELSE 'https://www.youtube.com/watch?v=' || doc_id END AS url, CASE WHEN doc_id % 5 = 0 THEN '(untitled)' ELSE lang END AS title,
    concat_ws(' · ', nullif(up, ''), CASE WHEN doc_id % 6 <> 0 THEN (floor(doc_id * 1.5)::BIGINT // 60)::VARCHAR || ':' || lpad((floor(doc_id * 1.5)::BIGINT % 60)::VARCHAR, 2, '0') END) AS excerpt,
    CASE WHEN doc_id % 7 = 0 THEN 'https://i.ytimg.com/vi/' || doc_id || '/hqdefault.jpg' ELSE 'https://t.org/2' END AS cover, up AS author,
    ({NOW} - greatest(doc_id % 9 - 1, 0))::BIGINT AS created_ts, 'watch later' AS tags, (doc_id % 9)::BIGINT AS source_rank
    FROM (SELECT *, CASE WHEN doc_id % 4 <> 0 THEN source WHEN doc_id % 8 = 0 THEN 'ch' ELSE '' END AS up FROM documents) WHERE doc_id % 13 <> 0""",
)

# --- state and details ------------------------------------------------------------------------------------------------

_RAW = """event_id AS id, user_id AS story_id, event_type AS title, props AS summary, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'T' || event_id END AS raw_title,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'T' || event_id || CASE event_id % 5 WHEN 0 THEN 'x y' WHEN 1 THEN ' z' ELSE '' END END AS raw_body,
  CASE event_id % 6 WHEN 0 THEN NULL WHEN 5 THEN 'telegram' ELSE 'email' END AS source_type,
  CASE WHEN event_id % 7 = 0 THEN 'https://z.org' ELSE 'https://mail.google.com/#inbox/m' || (event_id % 300) END AS gmail_url"""


def _raw_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*views.columns_of(_RAW))


_register(
    "hydrated_mentions",
    lambda s, d: state.hydrate(_raw_mentions(s, d), _docs(s, d).selectExpr("'m' || doc_id AS id", "lang AS subject", "text AS body")).select("id", "raw_title", "raw_body"),
    f"""SELECT e.id, coalesce(nullif(raw_title, ''), CASE WHEN asked THEN lang END) AS raw_title, coalesce(nullif(raw_body, ''), CASE WHEN asked THEN text END) AS raw_body
    FROM (SELECT *, id % 6 <> 5 AND id % 7 <> 0 AND (coalesce(raw_title, '') = '' OR raw_body IS NULL) AS asked FROM (SELECT {_RAW} FROM events)) e
    LEFT JOIN documents ON doc_id = e.id % 300""",
)
_register(
    "rendered_mentions", lambda s, d: feed.rendered_mentions(_raw_mentions(s, d)).select("id", "title", "summary"),
    f"""SELECT id, CASE WHEN mail THEN t ELSE title END AS title, CASE WHEN NOT mail THEN summary WHEN starts_with(b, t) AND regexp_matches(substr(b, length(t) + 1, 1), '[a-zA-Z0-9]')
      THEN t || chr(10) || chr(10) || substr(b, length(t) + 1) ELSE b END AS summary
    FROM (SELECT *, id % 6 <> 5 AS mail, coalesce(nullif(raw_title, ''), title) AS t, coalesce(nullif(raw_body, ''), summary) AS b FROM (SELECT {_RAW} FROM events))""",
)
_register(
    "saved_mentions", lambda s, d: feed.saved_mentions(feed.saved_rows(views.bookmarks(s, d), views.item_state(s, d), NOW)),
    views.SQL + """SELECT id AS story_id, title, excerpt AS summary, CASE WHEN author <> '' THEN author ELSE source END AS sender, url AS gmail_url,
    CASE WHEN created_ts <> 0 THEN created_ts ELSE last_seen_at END AS date_ts, source AS source_type FROM bookmarks""",
)


def _detail(name: str, story_id: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mentions = views.mentions(spark, sf_dir)
        timeline = mentions.where("added_new_info").select("id", "story_id", "date_ts")
        found = feed.story_detail(story_id, views.stories(spark, sf_dir), mentions, timeline, views.bookmarks(spark, sf_dir), views.item_state(spark, sf_dir), NOW)
        wanted = {"story": ["id", "title", "source_type", "mention_count"], "mentions": ["story_id", "date_ts"], "timeline": ["id", "date_ts"]}
        return found[name].select(*wanted[name])

    return run


_register("detail_story", _detail("story", 5), views.SQL + "SELECT id, title, source_type, mention_count FROM stories WHERE id = 5")
_register("detail_mentions", _detail("mentions", 5), views.SQL + "SELECT story_id, date_ts FROM mentions WHERE story_id = 5")
_register("detail_timeline", _detail("timeline", 5), views.SQL + "SELECT id, date_ts FROM mentions WHERE story_id = 5 AND added_new_info")
_register("detail_saved", _detail("story", 7), views.SQL + "SELECT id, title, source AS source_type, 1::BIGINT AS mention_count FROM bookmarks WHERE id = 7")
_register(
    "detail_saved_mention", _detail("mentions", 7),
    views.SQL + "SELECT id AS story_id, CASE WHEN created_ts <> 0 THEN created_ts ELSE last_seen_at END AS date_ts FROM bookmarks WHERE id = 7",
)


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "events").selectExpr("event_id AS mark", "user_id AS id", "event_id % 2 AS is_read")
    of_stories, of_items = state.route_marks(marks, views.stories(spark, sf_dir))
    return of_stories.withColumn("goes_to", F.lit("story")).unionByName(of_items.withColumn("goes_to", F.lit("item")))


_register(
    "routed_marks", _marks,
    views.SQL + "SELECT event_id AS mark, user_id AS id, event_id % 2 AS is_read, CASE WHEN user_id IN (SELECT id FROM stories) THEN 'story' ELSE 'item' END AS goes_to FROM events",
)
_register(
    "marked_seen", lambda s, d: state.mark_seen(views.item_state(s, d).select("id"), views.mentions(s, d).withColumn("id", F.col("story_id")), "id"),
    views.SQL + "SELECT DISTINCT story_id AS id FROM mentions WHERE story_id NOT IN (SELECT id FROM flags)",
)

# --- links ------------------------------------------------------------------------------------------------------------

_SHORT = "CASE doc_id % 4 WHEN 0 THEN 'https://t.co/' || doc_id WHEN 1 THEN 'https://click.a.org/' || doc_id WHEN 2 THEN 'https://bit.ly/none' ELSE 'https://b.org/' || doc_id END"


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    targets = docs.where("doc_id % 4 = 0").selectExpr("'https://t.co/' || doc_id AS url", "'https://click.a.org/' || (doc_id + 1) AS target").unionByName(
        docs.where("doc_id % 4 = 1").selectExpr("'https://click.a.org/' || doc_id AS url", "'https://c.org/' || doc_id AS target")
    )
    # Each target comes again with one that sorts behind it.
    targets = targets.unionByName(targets.selectExpr("url", "target || '/later' AS target")).unionByName(targets)
    return links.resolve(docs.selectExpr("doc_id", f"{_SHORT} AS url"), targets)


_register(
    "resolved_links", _resolved,
    f"""SELECT doc_id, u AS url, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id + 1 IN (SELECT doc_id FROM documents) THEN 'https://c.org/' || (doc_id + 1)
      ELSE 'https://click.a.org/' || (doc_id + 1) END WHEN doc_id % 4 = 1 THEN 'https://c.org/' || doc_id ELSE u END AS resolved
    FROM (SELECT doc_id, {_SHORT} AS u FROM documents)""",
)
_register(
    "post_link_rules",
    lambda s, d: _docs(s, d).selectExpr("doc_id", f"array({_SHORT}, 'https://x.com/a', 'https://d.org', '/in', 'https://t.me/b', '') AS l").select(
        "doc_id", F.transform("l", urls.clean_post_link).alias("l")
    ).select("doc_id", F.filter("l", lambda x: x.isNotNull()).alias("l")).select(
        "doc_id", F.array_join("l", "|").alias("kept"), F.array_join(urls.external_hosts(F.col("l")), "|").alias("hosts"), urls.is_roundup(F.col("l")).alias("roundup"),
        urls.is_sponsored(F.transform("l", lambda x: F.concat(x, F.lit("?erid=1")))).alias("sponsored"),
    ),
    f"""SELECT doc_id, u || '|https://x.com/a|https://d.org' AS kept, split_part(u, '/', 3) || '|d.org' AS hosts, false AS roundup, true AS sponsored
    FROM (SELECT doc_id, {_SHORT} AS u FROM documents)""",
)

# --- scans, streams, jobs ---------------------------------------------------------------------------------------------


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same events: the second adds nothing."""
    folder = f"{graph.shared_folder(spark).rstrip('/')}/append-{uuid.uuid4().hex}"
    for run in (1, 2):  # the second with a checkpoint of its own, so it reads all again
        stream = ingest.stream_table(spark, sf_dir, "events").select("user_id")
        log = ingest.append_unseen(stream, "user_id", f"{folder}/log", f"{folder}/state-{run}")
    return log.drop("batch")


_register("stream_append_unseen", _appended, "SELECT DISTINCT user_id FROM events")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status file for each job that has items; the first kinds of documents are the jobs', the last is no known job."""
    folder = f"{graph.shared_folder(spark).rstrip('/')}/jobs-{uuid.uuid4().hex}"
    kinds = [*saved.JOBS[:3], "zz"]
    counted = _docs(spark, sf_dir).groupBy((F.col("doc_id") % 5).alias("k")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    told = counted.where(F.col("k") < len(kinds)).select(
        F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("k") + 1).cast("int")).alias("job"),
        F.when(F.col("chars") % 2 == 0, "success").otherwise("failed").alias("status"), F.concat(F.col("n").cast("string"), F.lit(" items")).alias("message"),
    )
    told.write.partitionBy("job").json(folder)
    found = saved.job_statuses(spark, {job: f"{folder}/job={job}" for job in [*kinds, "youtube"]})
    return found.select("job", "label", "status", "ok", "message")


_register(
    "job_statuses", _jobs,
    """WITH t AS (SELECT ['email', 'telegram', 'social', 'zz'][(doc_id % 5 + 1)::INTEGER] AS job, CASE WHEN sum(n_chars) % 2 = 0 THEN 'success' ELSE 'failed' END AS status,
      count(*) || ' items' AS message FROM documents WHERE doc_id % 5 < 4 GROUP BY doc_id % 5)
    SELECT job, job AS label, status, status = 'success' AS ok, message FROM t
    UNION ALL SELECT 'youtube', 'youtube', 'idle', true, NULL""",
)


def _job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job counts its kind of documents and fails over an odd number; the last one never ran."""
    folder = f"{graph.shared_folder(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    paths = {job: f"{folder}/{job}.json" for job in saved.JOBS}
    for k, job in enumerate(saved.JOBS[:3]):
        with suppress(ValueError), saved.job_status(paths[job], job, f"Job {k}") as told:
            n = _docs(spark, sf_dir).where(F.col("doc_id") % 7 == k).count()
            if n % 2:
                raise ValueError(f"{n} is odd")
            told["message"] = f"{n} items"
    return saved.job_statuses(spark, paths).select("job", "label", "status", "ok", "message")


_register(
    "job_runs", _job_runs,
    """SELECT ['email', 'telegram', 'social'][(k + 1)::INTEGER] AS job, 'Job ' || k AS label, CASE WHEN n % 2 = 0 THEN 'success' ELSE 'failed' END AS status, n % 2 = 0 AS ok,
      n || CASE WHEN n % 2 = 0 THEN ' items' ELSE ' is odd' END AS message
    FROM (SELECT k, (SELECT count(*) FROM documents WHERE doc_id % 7 = k) AS n FROM (SELECT unnest(range(3)) AS k))
    UNION ALL SELECT 'youtube', 'youtube', 'idle', true, NULL""",
)
