"""The synthetic tables as the feed's tables, in Spark and, word for word, in SQL for the oracle.

documents are stories (mail and channel posts) or saved items (three networks) by id; events are mentions and
snapshots of saved items; labels are read and skip flags. The clock stands at ``NOW``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.session import table

NOW = 1_706_659_200  # 2024-01-31 00:00:00 UTC

_DOC = """doc_id AS id, text, lang,
  CASE doc_id % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'telegram' WHEN 2 THEN 'twitter' WHEN 3 THEN 'linkedin' ELSE 'youtube' END AS source_type,
  {now} - (doc_id * 3571) % 5184000 AS ts, 'https://www.' || source || '.example.org/' || CAST(doc_id AS {text}) AS url,
  CASE WHEN doc_id % 3 = 0 THEN 'https://img.example.org/' || CAST(doc_id AS {text}) ELSE '' END AS image,
  doc_id % 7 AS source_rank"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*columns_of(_DOC.format(now=NOW, text="STRING")))


def columns_of(sql: str) -> list[str]:
    """Top-level commas of a select list."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(sql[at:i])
            at = i + 1
    return [p.strip() for p in [*parts, sql[at:]]]


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).where("source_type IN ('email', 'telegram')")
    flags = table(spark, sf_dir, "labels").selectExpr("doc_id AS id", "quality = 1 AS is_read", "toxic = 1 AS skipped")
    first = F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 140)
    return docs.join(flags, "id", "left").select(
        "id", first.alias("title"), F.col("text").alias("summary"), F.col("url").alias("primary_url"),
        F.expr("substr(url, 13, instr(url, '.example') - 5)").alias("primary_url_host"), F.col("image").alias("primary_image_url"),
        "source_type", (F.col("id") % 9).alias("mention_count"), (F.col("id") % 4).alias("new_info_count"),
        F.coalesce("is_read", F.lit(False)).alias("is_read"), F.coalesce("skipped", F.lit(False)).alias("skipped"),
        (F.col("ts") - 86400).alias("first_seen"), F.col("ts").alias("last_updated"),
        F.expr("CASE id % 4 WHEN 0 THEN '[\"' || url || '\", 7, \"nowhere\", \"https://b.org/x\"]' WHEN 1 THEN '[broken' END").alias("links_json"),
    )


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).where("source_type IN ('twitter', 'linkedin', 'youtube')")
    return docs.selectExpr(
        "id", "source_type AS source", "url", "substring(split(text, '\\n')[0], 1, 140) AS title", "text AS excerpt",
        "CASE WHEN id % 6 = 2 THEN '{\"url\": \"https://www.card.example.org/' || id || '\"}' WHEN id % 6 = 4 THEN 'null' END AS link_card_json", "image AS cover", "CASE WHEN id % 11 = 0 THEN '' ELSE lang END AS author", "CASE WHEN id % 4 = 0 THEN 0 ELSE ts - 3600 END AS created_ts",
        "ts AS scraped_at", "ts + 60 AS last_seen_at", "source_rank",
    )


def item_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr("doc_id AS id", "quality = 1 AS is_read", "toxic = 1 AS skipped")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id AS story_id", "CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS sender",
        "CASE event_id % 5 WHEN 0 THEN 'email' WHEN 1 THEN ' Telegram' WHEN 2 THEN '' ELSE 'email' END AS source_type",
        "unix_timestamp(CAST(ts AS TIMESTAMP)) AS date_ts", "value > 50 AS added_new_info",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of saved items: a row each time a sync saw one."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS id", "event_id AS seen_seq", "unix_timestamp(CAST(ts AS TIMESTAMP)) AS seen_at", "event_type AS title",
        "'https://example.org/' || CAST(event_id AS STRING) AS url", "CAST(event_id % 4 AS BIGINT) AS source_rank",
        "CASE WHEN event_id % 3 = 0 THEN CAST(0 AS BIGINT) ELSE unix_timestamp(CAST(ts AS TIMESTAMP)) - 100 END AS created_ts",
    )


#: The same views as common table expressions of the oracle.
SQL = f"""WITH docs AS (SELECT {_DOC.format(now=NOW, text="VARCHAR")} FROM documents),
flags AS (SELECT doc_id AS id, quality = 1 AS is_read, toxic = 1 AS skipped FROM labels),
stories AS (
  SELECT id, substr(string_split(text, chr(10))[1], 1, 140) AS title, text AS summary, url AS primary_url,
    regexp_extract(url, '^https://www\\.([^/]*)', 1) AS primary_url_host, image AS primary_image_url, source_type, id % 9 AS mention_count,
    id % 4 AS new_info_count, coalesce(is_read, false) AS is_read, coalesce(skipped, false) AS skipped, ts - 86400 AS first_seen, ts AS last_updated,
    CASE id % 4 WHEN 0 THEN regexp_extract(url, '^https://www\\.([^/]*)', 1) || '|b.org' ELSE '' END AS link_hosts
  FROM docs LEFT JOIN flags USING (id) WHERE source_type IN ('email', 'telegram')),
bookmarks AS (
  SELECT id, source_type AS source, url, substr(string_split(text, chr(10))[1], 1, 140) AS title, text AS excerpt, image AS cover,
    CASE WHEN id % 11 = 0 THEN '' ELSE lang END AS author, CASE WHEN id % 4 = 0 THEN 0 ELSE ts - 3600 END AS created_ts, ts AS scraped_at,
    ts + 60 AS last_seen_at, source_rank, CASE WHEN id % 6 = 2 THEN 'card.example.org' ELSE '' END AS link_hosts
  FROM docs WHERE source_type IN ('twitter', 'linkedin', 'youtube')),
mentions AS (
  SELECT event_id AS id, user_id AS story_id, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS sender,
    CASE event_id % 5 WHEN 1 THEN 'telegram' ELSE 'email' END AS source_type, floor(epoch(ts))::BIGINT AS date_ts, value > 50 AS added_new_info
  FROM events),
snapshots AS (
  SELECT user_id AS id, event_id AS seen_seq, floor(epoch(ts))::BIGINT AS seen_at, event_type AS title, 'https://example.org/' || event_id::VARCHAR AS url,
    event_id % 4 AS source_rank, CASE WHEN event_id % 3 = 0 THEN 0 ELSE floor(epoch(ts))::BIGINT - 100 END AS created_ts FROM events),
first_spelling AS (
  SELECT story_id, lower(trim(sender)) AS key, arg_min(trim(sender), id) AS sender, min(id) AS first_id FROM mentions WHERE trim(sender) <> '' GROUP BY ALL),
sender_agg AS (
  SELECT story_id, string_agg(sender, '|' ORDER BY first_id) AS senders, count(*) AS n_senders FROM first_spelling GROUP BY story_id),
mention_agg AS (
  SELECT story_id, string_agg(DISTINCT source_type, '|' ORDER BY source_type) AS source_types, count(DISTINCT source_type) AS n_types,
    max(date_ts) AS latest, list(DISTINCT lower(sender)) AS all_senders FROM mentions GROUP BY story_id),
feed AS (
  SELECT id, title, summary, primary_url, primary_url_host, primary_image_url, source_type, mention_count, new_info_count, is_read, skipped, first_seen,
    last_updated, sort_ts, floor(({NOW} - sort_ts) / 86400)::BIGINT AS age_days, 0 AS source_rank, coalesce(all_senders, []) AS all_senders,
    coalesce(senders, '') AS senders, coalesce(n_senders, 0) AS distinct_sender_count, coalesce(source_types, source_type) AS distinct_source_types,
    coalesce(n_types, 1) AS n_types, link_hosts
  FROM (SELECT s.*, a.all_senders, d.senders, d.n_senders, a.source_types, a.n_types,
          CASE WHEN s.source_type = 'email' AND a.latest IS NOT NULL THEN a.latest ELSE s.last_updated END AS sort_ts
        FROM (SELECT * FROM stories ORDER BY last_updated DESC, id DESC LIMIT 2000) s
        LEFT JOIN mention_agg a ON a.story_id = s.id LEFT JOIN sender_agg d ON d.story_id = s.id)
  UNION ALL
  SELECT b.id, title, excerpt, url, regexp_extract(url, '^https://www\\.([^/]*)', 1), cover, source, 1, 0, coalesce(is_read, false), coalesce(skipped, false),
    CASE WHEN created_ts <> 0 THEN created_ts ELSE last_seen_at END, scraped_at, scraped_at, floor(({NOW} - scraped_at) / 86400)::BIGINT, source_rank,
    [lower(CASE WHEN author <> '' THEN author ELSE source END)], CASE WHEN author <> '' THEN author ELSE source END, 1, source, 1, link_hosts
  FROM bookmarks b LEFT JOIN flags USING (id)),
scored AS (
  SELECT *, round((2.6 * ln(1 + greatest(mention_count, 1)) + 1.2 * ln(1 + greatest(distinct_sender_count, 1)) + 2.4 * (greatest(n_types, 1) - 1)
      + 1.8 * greatest(new_info_count, 0) + CASE WHEN primary_image_url <> '' THEN 0.35 ELSE 0 END + CASE WHEN primary_url <> '' THEN 0.3 ELSE 0 END)
    * greatest(0.2, exp(-greatest(({NOW} - last_updated) / 3600.0, 0) / 36.0))
    - 0.55 * greatest(greatest(mention_count, 1) - greatest(distinct_sender_count, 1), 0), 6) AS score FROM feed)
"""
