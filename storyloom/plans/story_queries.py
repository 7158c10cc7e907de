"""Queries of the feed's display, story runs, clusters and model calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import clusters, models, state
from storyloom.plans import feed_queries, text_queries, views
from storyloom.plans.views import NOW
from storyloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


_register(
    "feed_display",
    lambda s, d: feed_queries.base(s, d).select(
        "id", "source_label", "last_updated_display", "last_updated_relative", "first_seen_relative", F.array_join(F.transform("links", lambda x: x["host"]), "|").alias("link_hosts")
    ),
    views.SQL + f"""SELECT id, CASE source_type WHEN 'email' THEN 'Email' WHEN 'telegram' THEN 'Telegram' WHEN 'twitter' THEN 'Twitter' WHEN 'linkedin' THEN 'LinkedIn' ELSE 'YouTube' END AS source_label,
    strftime(to_timestamp(sort_ts + 19800) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+05:30' AS last_updated_display, {text_queries.label_sql(f'{NOW} - sort_ts')} AS last_updated_relative,
    {text_queries.label_sql(f'{NOW} - first_seen')} AS first_seen_relative, link_hosts FROM feed""",
)

# --- runs of ingestion ------------------------------------------------------------------------------------------------

THRESHOLD, KNOWN = 0.4, 40  # no pair of the synthetic vectors reaches the production threshold


def check(told: str, title: str, summary: str) -> tuple[bool, str, str]:
    """News if the title's number is odd; the change is put after the summary."""
    return int(title[1:]) % 2 == 1, f"now {title}", ""


def begun(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, Callable]:
    """(items, stories, vectors, embed): vectors as items; the first ones are stories of a run before."""
    rows = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS id", "concat('t', vec_id) AS title", "concat('s', label) AS summary", "'x' AS sender", "'' AS gmail_url", "'d' AS date", "'email' AS source_type", "embedding"
    )
    old = rows.where(F.col("id") < KNOWN)
    stories = old.selectExpr(
        "id AS story_id", "title", "summary", "id % 3 + 1 AS mention_count", "0L AS new_info_count", "true AS is_read", f"{NOW - 9}L AS first_seen", f"{NOW - 9}L AS last_updated"
    )
    vectors = old.selectExpr("id", "CAST(embedding AS array<double>) AS vector")
    # The vector comes with the item, and one in fifty is missing.
    new = rows.where(F.col("id") >= KNOWN)
    embed = lambda _: F.expr("CASE WHEN id % 50 = 7 THEN NULL ELSE CAST(embedding AS array<double>) END")
    return new, stories, vectors, embed


def _run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    new, stories, vectors, embed = begun(spark, sf_dir)
    return clusters.persist_stories(new, stories, vectors, embed, check, NOW, THRESHOLD, exact=True)


_STEPS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.id < b.id AND b.id >= {{known}} AND a.id % {{skip}} <> {{gap}} AND b.id % {{skip}} <> {{gap}}
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
c AS (SELECT b, list(a) AS near FROM p GROUP BY b),
o AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM v WHERE id >= {{known}} AND id % {{skip}} <> {{gap}}),
r AS (SELECT 0::BIGINT AS k, (SELECT coalesce(list(id), []::BIGINT[]) FROM v WHERE id < {{known}}) AS leaders
  UNION ALL SELECT r.k + 1, CASE WHEN list_has_any(leaders, coalesce(near, []::BIGINT[])) THEN leaders ELSE list_append(leaders, o.id) END FROM r JOIN o ON o.k = r.k + 1 LEFT JOIN c ON c.b = o.id),
l AS (SELECT unnest(arg_max(leaders, k)) AS id FROM r),
m AS (SELECT b AS id, arg_max(a, (s, -a)) AS leader, max(s) AS s FROM p WHERE a IN (SELECT id FROM l) AND b NOT IN (SELECT id FROM l) GROUP BY b)"""
_register(
    "leader_clusters",
    lambda s, d: clusters.leader_clusters(
        table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), THRESHOLD, exact=True
    ).withColumn("similarity", F.round("similarity", 6)),
    _STEPS.format(known=-1, skip=1, gap=1) + " SELECT id, id AS leader, 1.0::DOUBLE AS similarity FROM l UNION ALL SELECT id, leader, round(s, 6) FROM m",
)
# An old story 7 (a vector that items lack) takes part, so the gap is of new items only.
_RUN = _STEPS.format(known=KNOWN, skip=50, gap=7).replace("AND a.id % 50 <> 7", f"AND (a.id < {KNOWN} OR a.id % 50 <> 7)") + f""",
g AS (
  SELECT id, story, story >= {KNOWN} AND id = story AS made, row_number() OVER (PARTITION BY story ORDER BY id) - 1 + CASE WHEN story < {KNOWN} THEN story % 3 + 1 ELSE 0 END AS n_before
  FROM (SELECT id, id AS story FROM l WHERE id >= {KNOWN} UNION ALL SELECT id, leader FROM m)),
x AS (SELECT *, CASE WHEN made THEN 'new' WHEN n_before >= 2 AND id % 2 = 1 THEN 'evolved' ELSE 'merged' END AS outcome FROM g)"""
_register(
    "persist_stories", lambda s, d: _run(s, d)["stories"],
    _RUN + f""" SELECT story_id, 't' || story_id AS title, trim('s' || label || coalesce(' ' || changes, '')) AS summary, (first + coalesce(n, 0))::BIGINT AS mention_count,
    coalesce(news, 0)::BIGINT AS new_info_count, old AND coalesce(news, 0) = 0 AS is_read, CASE WHEN old THEN {NOW - 9} ELSE {NOW} END::BIGINT AS first_seen,
    CASE WHEN n IS NULL THEN {NOW - 9} ELSE {NOW} END::BIGINT AS last_updated
    FROM (SELECT id AS story_id, label, id < {KNOWN} AS old, CASE WHEN id < {KNOWN} THEN id % 3 + 1 ELSE 0 END AS first FROM v WHERE id IN (SELECT id FROM l))
    LEFT JOIN (SELECT story AS story_id, count(*) AS n, count_if(outcome = 'evolved') AS news, string_agg('now t' || id, ' ' ORDER BY id) FILTER (WHERE outcome = 'evolved') AS changes
      FROM x GROUP BY story) USING (story_id)""",
)
_register(
    "persist_timeline", lambda s, d: _run(s, d)["timeline"],
    _RUN + " SELECT story AS story_id, id, 'd' AS date, 'now t' || id AS what_changed, 'x' AS trigger_sender FROM x WHERE outcome = 'evolved'",
)
_register(
    "persist_mentions", lambda s, d: _run(s, d)["mentions"].select("id", "story_id", "added_new_info"),
    _RUN + " SELECT id, story AS story_id, outcome = 'evolved' AS added_new_info FROM x",
)
_register(
    "persist_outcomes", lambda s, d: state.outcome_counts(_run(s, d)["outcomes"]),
    _RUN + f" SELECT outcome, count(*) AS n FROM (SELECT outcome FROM x UNION ALL SELECT 'failed' FROM v WHERE id >= {KNOWN} AND id % 50 = 7) GROUP BY outcome",
)
_register(
    "persist_vectors", lambda s, d: _run(s, d)["vectors"].select("id", F.size("vector").cast("long").alias("n")),
    _RUN + " SELECT id, 64::BIGINT AS n FROM l",
)


def _evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as mentions of stories of fifty ids each; the number of stories grows with the table."""
    told = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.expr("doc_id DIV 50").alias("story_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("text").alias("summary"),
    )
    return clusters.evolve(told, models.Offline().evolve).select("id", "story_id", "outcome", "what_changed", F.md5("story_summary").alias("summary_md5"))


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"
_register(
    "evolve_stories", _evolved,
    f"""WITH RECURSIVE d AS (
  SELECT doc_id AS id, doc_id // 50 AS story_id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS k, string_split(text, chr(10))[1] AS title, text AS summary FROM documents),
w AS (SELECT *, {_WORDS.format("title || ' ' || summary")} AS ws FROM d),
r AS (
  SELECT id, story_id, k, 'new' AS outcome, NULL::VARCHAR AS what_changed, summary AS told, true AS fresh FROM w WHERE k = 1
  UNION ALL SELECT id, story_id, k, CASE WHEN news THEN 'evolved' ELSE 'merged' END, CASE WHEN news THEN title END, CASE WHEN news THEN {text_queries.strip_sql("told || ' ' || title")} ELSE told END, news
  FROM (SELECT w.*, r.told, w.k > 2 AND title <> '' AND 2 * (len(ws) - len(list_intersect(ws, {_WORDS.format('r.told')}))) >= greatest(len(ws), 1) AS news
    FROM r JOIN w ON w.story_id = r.story_id AND w.k = r.k + 1))
SELECT id, story_id, outcome, what_changed, CASE WHEN fresh THEN md5(told) END AS summary_md5 FROM r""",
)

# --- models -----------------------------------------------------------------------------------------------------------

_BANNED = ", ".join(f"'{t}'" for t in models.META_TITLES)


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "CASE WHEN doc_id % 4 = 0 THEN replace(text, '\\n', '\\n \\n') || '\\n\\nType A\\nbody' ELSE text END AS body")


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.extract_stories(mails(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


_register(
    "extract_stories", _extracted,
    f"""WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN replace(text, chr(10), chr(10) || ' ' || chr(10)) || chr(10) || chr(10) || 'Type A' || chr(10) || 'body' ELSE text END AS body FROM documents),
p AS (SELECT id, list_filter(list_transform(string_split_regex({text_queries.strip_sql('body')}, '\\n{text_queries.BLANK_SQL}*\\n'), lambda x: {text_queries.strip_sql('x')}), lambda x: x <> '') AS ps FROM d),
s AS (SELECT id, len(ps) AS n, unnest(ps) AS part, generate_subscripts(ps, 1) - 1 AS pos FROM p),
t AS (SELECT *, {text_queries.strip_sql("string_split(part, chr(10))[1]")} AS title,
  {text_queries.strip_sql("CASE WHEN contains(part, chr(10)) THEN substr(part, strpos(part, chr(10)) + 1) ELSE part END")} AS summary FROM s)
SELECT id, pos::BIGINT AS pos, CASE WHEN n <= 1 THEN 'single_article' ELSE 'curated_digest' END AS content_type, title, summary, false AS failed
FROM t WHERE title <> '' AND summary <> '' AND lower(title) NOT IN ({_BANNED})""",
)


def _limited() -> Callable[[str], str]:
    """A provider whose first model is at its limit for every third prompt, and the second for every ninth."""

    def call(model: str, prompt: str) -> str:
        number = int(prompt)
        if (model == "large" and number % 3 == 0) or (model == "medium" and number % 9 == 0):
            raise RuntimeError("429 too many requests")
        return f"{model}:{number}"

    return models.Rotating(["large", "medium", "small"], call).chat


_register(
    "model_rotation", lambda s, d: table(s, d, "documents").select("doc_id", models.chat(F.col("doc_id").cast("string"), _limited).alias("answer")),
    "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'small:' WHEN doc_id % 3 = 0 THEN 'medium:' ELSE 'large:' END || doc_id AS answer FROM documents",
)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message with a system text before it, as the two messages of a request."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    message = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    both = F.array(message(F.lit(" System"), F.concat(F.lit(" be "), F.col("turn").cast("string"))), message(F.col("role"), F.col("text")))
    found = rows.select("conv_id", "turn", models.split_messages(both).alias("m"))
    return found.select(
        "conv_id", "turn", F.col("m.system").alias("system"), F.array_join(F.transform("m.contents", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "|").alias("contents")
    )


_register(
    "split_messages", _split,
    f"""SELECT conv_id, turn, 'be ' || turn || CASE WHEN lower(trim(role)) = 'system' AND {text_queries.strip_sql('text')} <> '' THEN chr(10) || chr(10) || {text_queries.strip_sql('text')} ELSE '' END AS system,
    CASE WHEN lower(trim(role)) = 'system' THEN 'user: ' WHEN lower(trim(role)) = 'assistant' THEN 'model: ' || text ELSE 'user: ' || text END AS contents FROM conversations""",
)
