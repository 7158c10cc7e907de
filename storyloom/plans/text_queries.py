"""Queries of the text, URL, time and link functions over the synthetic tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import links, text, times, urls
from storyloom.operators import graph, state
from storyloom.plans.views import NOW
from storyloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_WS = r"[ \t\n\x0B\f\r]"


def _docs(name: str, sql: str, **columns: Callable[[], F.Column]) -> None:
    QUERIES[name] = lambda s, d: table(s, d, "documents").select("doc_id", *[c().alias(n) for n, c in columns.items()])
    ORACLES[name] = f"SELECT doc_id, {sql} FROM documents"


def _pages(name: str, sql: str, **columns: Callable[[], F.Column]) -> None:
    QUERIES[name] = lambda s, d: table(s, d, "pages").select("page_id", *[c().alias(n) for n, c in columns.items()])
    ORACLES[name] = f"SELECT page_id, {sql} FROM pages"


def any_sql(column: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


BLANK_SQL = _BLANK = text.BLANK
_NO_BLANK = text.NO_BLANK
#: The same characters as ``text.BLANKS``, as SQL.
_BLANKS = "' ' || " + " || ".join(f"chr({ord(c)})" for c in text.BLANKS if c != " ")


def strip_sql(expression: str) -> str:
    return f"trim({expression}, {_BLANKS})"


def clean_sql(expression: str) -> str:
    """Text of HTML as ``text.clean_html`` makes it, but for white space at the ends."""
    for pattern, by in _HTML_STEPS:
        expression = f"regexp_replace({expression}, '{pattern}', {by}, 'g')"
    for entity, by in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        expression = f"replace({expression}, '{entity}', '{by}')"
    return rf"regexp_replace({expression}, '\n{_BLANK}*\n+', chr(10) || chr(10), 'g')"


_HTML_STEPS = (
    (r"(?is)<style[^>]*>.*?</style>", "''"), (r"(?is)<script[^>]*>.*?</script>", "''"), (r"(?i)</(div|p|li|tr|h[1-6])>", "chr(10)"), (r"(?i)<br[^>]*>", "chr(10)"),
    (r"<[^>]+>", "''"),
)


def stub_sql(x: str) -> str:
    return rf"((length({x}) < 350 AND {any_sql(f'lower({x})', text.STUB_PHRASES)}) OR (length({x}) < 1200 AND len(regexp_extract_all({x}, 'https?://{_NO_BLANK}+')) >= 3))"


def score_sql(x: str) -> str:
    phrases = " + ".join(f"contains(lower({x}), '{p}')::INT" for p in text.STUB_PHRASES)
    return rf"""(length({x}) + 12 * least(length({x}) - length(replace({x}, chr(10), '')), 300) + 25 * least(len(regexp_extract_all({x}, '[.!?](?:\s|$)')), 120)
    - 2500 * ({phrases}) - 120 * len(regexp_extract_all({x}, 'https?://{_NO_BLANK}+')))::BIGINT"""


_docs("promo_flag", rf"regexp_matches(text, '(?i){text.PROMO_SUBJECT}') OR length(text) < 800 AS promo", promo=lambda: text.is_promotional(F.col("text"), F.col("text")))
_docs(
    "skip_rule_subject",
    f"(starts_with(s, 're:') OR starts_with(s, 'fwd:') OR {any_sql('s', text.SKIPPED_SUBJECTS)}) AS skip FROM (SELECT doc_id, lower(string_split(text, chr(10))[1]) AS s FROM documents) --",
    skip=lambda: text.skip_email(text.first_line(F.col("text")), F.lit("a@b.c")),
)
ORACLES["skip_rule_subject"] = ORACLES["skip_rule_subject"].split(" --")[0]
_docs(
    "skip_rule_sender",
    f"""({any_sql('s', ('github.com', 'no-reply@accounts.google.com', *text.TRANSACTIONAL))} OR ({any_sql('s', text.AUTOMATIC)} AND NOT {any_sql('s', text.NEWSLETTER_SERVICES)})) AS skip
    FROM (SELECT doc_id, lower(CASE doc_id % 5 WHEN 0 THEN 'Shop <noreply@x.com>' WHEN 1 THEN 'alerts@substack.com' WHEN 2 THEN 'a@uber.com' ELSE source || '@y.org' END) AS s FROM documents)""",
    skip=lambda: text.skip_email(
        F.lit("news"),
        F.expr("CASE doc_id % 5 WHEN 0 THEN 'Shop <noreply@x.com>' WHEN 1 THEN 'alerts@substack.com' WHEN 2 THEN 'a@uber.com' ELSE source || '@y.org' END"),
    ),
)
ORACLES["skip_rule_sender"] = ORACLES["skip_rule_sender"].removesuffix(" FROM documents")
_LINKED = "text || CASE doc_id % 3 WHEN 0 THEN ' https://a.org/x\u00a0end' WHEN 1 THEN '\u2003http://b.org' ELSE '' END"
HASH_SQL = rf"substr({strip_sql(rf'''regexp_replace(regexp_replace(lower({_LINKED}), 'https?://{_NO_BLANK}+', '', 'g'), '{_BLANK}+', ' ', 'g')''')}, 1, 500)"


def linked() -> F.Column:
    """Text with links before blanks of other scripts."""
    return F.expr(_LINKED)


_docs("content_hash", f"CASE WHEN {HASH_SQL} = '' THEN '' ELSE sha1({HASH_SQL}) END AS content_hash", content_hash=lambda: text.content_hash(linked()))
_docs("letter_share", "round(a / nullif(a + b, 0), 9) AS share FROM (SELECT doc_id, len(regexp_extract_all(text, '[À-ÿ]'))::DOUBLE AS a, len(regexp_extract_all(text, '[a-zA-Z]')) AS b FROM documents)",
      share=lambda: F.round(text.letter_share(F.col("text"), "À-ÿ"), 9))
ORACLES["letter_share"] = ORACLES["letter_share"].removesuffix(" FROM documents")
_docs("needs_translation", "doc_id % 2 = 0 AND regexp_matches(text, '[aeio]') AND len(regexp_extract_all(text, '[aeio]')) >= 0.15 * len(regexp_extract_all(text, '[A-Za-z]')) AS needed",
      needed=lambda: text.needs_translation(F.expr("CASE WHEN doc_id % 2 = 0 THEN translate(text, 'aeio', 'аеио') ELSE text END")))
_docs("body_score", f"{score_sql(_LINKED)} AS score", score=lambda: text.body_score(linked()))
_docs("stub_flag", f"{stub_sql(_LINKED)} AS stub", stub=lambda: text.is_stub(linked()))
_PLAIN = f"regexp_replace(regexp_replace({_LINKED}, 'https?://{_NO_BLANK}+', '', 'g'), 'www\\.{_NO_BLANK}+', '', 'g')"
_PLAIN = rf"regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
_docs("strip_urls", f"{strip_sql(_PLAIN)} AS plain", plain=lambda: text.strip_urls(linked()))
_docs("scrub_pii", r"regexp_replace(regexp_replace(text, '(?i)[a-z0-9._]+@[a-z0-9.]+', '[REDACTED]', 'g'), '(?i)\d{3}-\d{4}', '[REDACTED]', 'g') AS clean",
      clean=lambda: text.scrub(F.col("text"), [r"[a-z0-9._]+@[a-z0-9.]+", r"\d{3}-\d{4}"]))
_docs("md5_bucket", "('0x' || substr(md5(text), 1, 8))::BIGINT AS bucket", bucket=lambda: text.md5_bucket(F.col("text")))
_docs("first_line_title", r"substr(trim(string_split(text, chr(10))[1]), 1, 140) AS title", title=lambda: F.substring(F.btrim(text.first_line(F.col("text"))), 1, 140))
_docs("word_sets", "len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2)))::BIGINT AS n_words",
      n_words=lambda: F.size(text.word_set(F.col("text"))).cast("long"))
_docs("cut_title", "CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS title FROM (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents)",
      title=lambda: text.cut_title(text.first_line(F.col("text")), 60))
ORACLES["cut_title"] = ORACLES["cut_title"].removesuffix(" FROM documents")
_docs("source_labels", "CASE doc_id % 3 WHEN 0 THEN 'Email' WHEN 1 THEN 'LinkedIn' ELSE 'My Feed' END AS label",
      label=lambda: text.source_label(F.expr("CASE doc_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'linkedin' ELSE 'my_feed' END")))

_clean = strip_sql(clean_sql("html"))
_pages("clean_html", f"{_clean} AS plain", plain=lambda: text.clean_html(F.col("html")))
_host = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '')"
_pages("host_of", f"{_host} AS host", host=lambda: urls.host_of(F.col("url")))
_WRAPS = "|".join(p.removesuffix(".") for p in urls.WRAPPER_PREFIXES)
_pages("wrapper_hosts", rf"regexp_matches({_host}, '^({_WRAPS})\.') AS wrapper", wrapper=lambda: urls.is_wrapper_host(urls.host_of(F.col("url"))))
_pages("bad_urls", f"(NOT regexp_matches(lower(url), '^https?://') OR {any_sql('lower(url)', urls.BAD_URL_PARTS)} OR {_host} = 'example.com' OR ends_with({_host}, '.example.com')) AS bad",
       bad=lambda: urls.is_bad_url(F.col("url"), F.lit("example.com")))

_NOCODE = "regexp_replace(regexp_replace(html, '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g')"
#: What an anchor with a target is, as a pattern; the library reads it by places instead.
_A = r"""<a\s+[^>]*href\s*=\s*["'']([^"'']+)["''][^>]*>(.*?)</a>"""
_LINKS = rf"""links AS (SELECT page_id, url, unnest(regexp_extract_all(x, '(?is){_A}', 1)) AS href, unnest(regexp_extract_all(x, '(?is){_A}', 2)) AS inside,
  generate_subscripts(regexp_extract_all(x, '(?is){_A}', 1), 1) - 1 AS pos FROM (SELECT page_id, url, {_NOCODE} AS x FROM pages)),
plain AS (SELECT page_id, url, pos, trim(href) AS href, trim(regexp_replace(regexp_replace(inside, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS anchor FROM links WHERE trim(href) <> '')"""


def _page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(links.links_in_context(F.col("html"))).alias("pos", "l"))
    return rows.select("page_id", "url", F.col("pos").cast("long").alias("pos"), "l.anchor", "l.href")


QUERIES["page_links"] = lambda s, d: _page_links(s, d).drop("url")
ORACLES["page_links"] = f"WITH {_LINKS} SELECT page_id, pos::BIGINT AS pos, anchor, href FROM plain"
QUERIES["link_hosts"] = lambda s, d: (
    _page_links(s, d).select(urls.host_of(links.absolute(F.col("href"), F.col("url"))).alias("host")).groupBy("host").agg(F.count("*").alias("n"))
)
ORACLES["link_hosts"] = rf"""WITH {_LINKS},
r AS (SELECT CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([^:]*:)', 1) || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) || href
  ELSE coalesce(nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^?#]*/)', 1), ''), regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) || '/') || href END AS url FROM plain)
SELECT {_host} AS host, count(*) AS n FROM r GROUP BY 1"""


_SHORTENED = "length(href) % 3 = 0"


def _primary(spark: SparkSession, sf_dir: str, shortened: bool = False) -> DataFrame:
    """``shortened``: a third of the links are given in a short form, with tables of targets that also hold later ones."""
    # Pages are read once: links and text come from the same stored rows.
    read = table(spark, sf_dir, "pages").select(
        "page_id", "url", links.links_in_context(F.col("html")).alias("links"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"),
        text.clean_html(F.col("html")).alias("summary"),
    )
    read = graph.cut(read)
    found = read.select("page_id", "url", F.posexplode("links").alias("pos", "l")).select("page_id", "url", "pos", "l.anchor", "l.href")
    found = found.withColumn("href", links.absolute(F.col("href"), F.col("url"))).withColumn("context", F.lit(""))
    stories = read.select(F.col("page_id").alias("story_id"), F.col("page_id").alias("source_id"), "title", "summary")
    found = found.withColumnRenamed("page_id", "source_id")
    if not shortened:
        return links.primary_links(stories, found)
    found = graph.cut(found)
    targets = found.where(_SHORTENED).selectExpr("'https://t.co/' || md5(href) AS url", "href AS target").distinct()
    targets = targets.unionByName(targets.selectExpr("url", "target || '~later' AS target")).unionByName(targets)
    return links.primary_links(stories, found.withColumn("href", F.expr(f"CASE WHEN {_SHORTENED} THEN 'https://t.co/' || md5(href) ELSE href END")), targets=targets)


QUERIES["primary_link"] = _primary
_W = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 2))"
ORACLES["primary_link"] = rf"""WITH {_LINKS},
r AS (SELECT page_id, pos, anchor, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([^:]*:)', 1) || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) || href
  ELSE coalesce(nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^?#]*/)', 1), ''), regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) || '/') || href END AS href FROM plain),
st AS (SELECT page_id, {_W.format("(regexp_extract(html, '(?is)<title>(.*?)</title>', 1) || ' ' || substr(p, 1, 220))")} AS w
  FROM (SELECT page_id, html, {_clean} AS p FROM pages)),
sc AS (SELECT page_id, pos, href, length(anchor) AS al, 3 * len(list_intersect(w, {_W.format('anchor')})) AS score FROM st JOIN r USING (page_id)
  WHERE regexp_matches(lower(href), '^https?://') AND NOT {any_sql('lower(href)', urls.BAD_URL_PARTS)})
SELECT page_id AS story_id, href AS primary_url FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, al DESC, pos) AS k FROM sc WHERE score >= 2)
WHERE k = 1 AND NOT regexp_matches(href, '^[A-Za-z]+://(www\.)?({_WRAPS})\.')"""
QUERIES["primary_link_followed"] = lambda s, d: _primary(s, d, True)
ORACLES["primary_link_followed"] = ORACLES["primary_link"].replace(
    "WHERE regexp_matches(lower(href), '^https?://') AND NOT", f"WHERE {_SHORTENED} OR regexp_matches(lower(href), '^https?://') AND NOT"
).replace("WHERE k = 1 AND", f"WHERE k = 1 AND regexp_matches(lower(href), '^https?://') AND NOT {any_sql('lower(href)', urls.BAD_URL_PARTS)} AND")



def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(linked()).alias("hash"))
    return state.first_by_hash(graph.cut(rows), "hash", ["doc_id"]).select("doc_id", "status")


QUERIES["hash_dedup"] = _dedup
ORACLES["hash_dedup"] = f"""SELECT doc_id, CASE WHEN h = '' THEN 'empty' WHEN k = 1 THEN 'new' ELSE 'duplicate' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS k FROM (SELECT doc_id, {HASH_SQL} AS h FROM documents))"""


def _dedup_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(linked()).alias("hash"))
    return state.first_by_hash(graph.cut(rows), "hash", ["doc_id"], ok=F.col("doc_id") % 3 != 0).groupBy("status").agg(F.count("*").alias("n"))


QUERIES["hash_dedup_retry"] = _dedup_retry
ORACLES["hash_dedup_retry"] = f"""SELECT CASE WHEN h = '' THEN 'empty' WHEN f IS NULL OR doc_id < f THEN 'retry' WHEN doc_id = f THEN 'new' ELSE 'duplicate' END AS status, count(*) AS n
FROM (SELECT *, min(doc_id) FILTER (WHERE doc_id % 3 <> 0) OVER (PARTITION BY h) AS f FROM (SELECT doc_id, {HASH_SQL} AS h FROM documents)) GROUP BY 1"""

def _ts() -> F.Column:
    return F.unix_timestamp(F.col("ts").cast("timestamp"))


def _events(name: str, sql: str, **columns: Callable[[], F.Column]) -> None:
    QUERIES[name] = lambda s, d: table(s, d, "events").select("event_id", *[c().alias(n) for n, c in columns.items()])
    ORACLES[name] = f"SELECT event_id, {sql} FROM (SELECT *, floor(epoch(ts))::BIGINT AS t FROM events)"


_events("age_days", f"floor(({NOW} - t) / 86400)::BIGINT AS age_days", age_days=lambda: times.age_days(_ts(), NOW))
_events("freshness", f"round(greatest(0.2, exp(-greatest(({NOW} - t) / 3600.0, 0) / 36.0)), 9) AS fresh", fresh=lambda: F.round(times.freshness(_ts(), NOW), 9))
_events("iso_text", "strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS iso", iso=lambda: times.iso_from_ts(_ts()))
_events("time_roundtrip", "t AS back", back=lambda: F.unix_timestamp(times.parse_time(F.concat(F.date_format(F.timestamp_seconds(_ts()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), NOW)))
_MAIL_FORMS = (
    "'Mon, 'd MMM yyyy HH:mm:ss' +0000'", "'Tue, 'dd MMM yyyy HH:mm:ss' GMT'", "d MMM yyyy HH:mm:ss' +0000 (UTC)'", "'Wednesday, 'd MMMM yy HH:mm:ss' EST'", "d MMM yyyy HH:mm:ss' -0000'",
    "yyyy-MM-dd HH:mm:ss'+05:30'", "yyyy-MM-dd'T'HH:mm:ss",
)


def _mail_date() -> F.Column:
    at = F.timestamp_seconds(_ts())
    return F.coalesce(*[F.when(F.col("event_id") % len(_MAIL_FORMS) == k, F.date_format(at, form)) for k, form in enumerate(_MAIL_FORMS)])


_events(
    "mail_dates", f"""CASE event_id % {len(_MAIL_FORMS)} WHEN 3 THEN t + 5 * 3600 WHEN 5 THEN t - 19800 WHEN 4 THEN t - CASE WHEN t > {NOW} THEN 19800 ELSE 0 END
    WHEN 6 THEN t - CASE WHEN t > {NOW} THEN 19800 ELSE 0 END ELSE t END AS back""",
    back=lambda: F.unix_timestamp(times.parse_time(_mail_date(), NOW)),
)
_events("mail_dates_minutes", "CASE WHEN event_id % 2 = 0 THEN t - t % 60 END AS back", back=lambda: F.unix_timestamp(times.parse_time(
    F.when(F.col("event_id") % 2 == 0, F.date_format(F.timestamp_seconds(_ts()), "d MMM yyyy HH:mm' UTC'")).otherwise(F.lit("32 Foo 2024 99:00")), NOW)))
_UNITS = [("g < 60", "g", "a second", "second"), ("g < 3600", "g // 60", "a minute", "minute"), ("g < 86400", "g // 3600", "an hour", "hour"),
          ("y = 0 AND m = 0", "d", "a day", "day"), ("y = 0", "m", "a month", "month")]


def label_sql(gone: str) -> str:
    """A number of seconds in words, as ``times.relative_label`` has them."""
    units = " ".join(f"WHEN {when} THEN CASE WHEN {n} = 1 THEN '{one}' ELSE ({n})::VARCHAR || ' {name}s' END" for when, n, one, name in _UNITS)
    told = f"""CASE WHEN ({gone}) = 0 THEN 'now' ELSE CASE {units} WHEN y = 1 AND d = 0 THEN 'a year' WHEN y = 1 AND m = 0 THEN '1 year, ' || d || CASE WHEN d = 1 THEN ' day' ELSE ' days' END
    WHEN y = 1 THEN '1 year, ' || m || CASE WHEN m = 1 THEN ' month' ELSE ' months' END ELSE y || ' years' END || CASE WHEN ({gone}) < 0 THEN ' from now' ELSE ' ago' END END"""
    for name, value in (("m", "(d * 2 // 61)"), ("d", "(g // 86400 % 365)"), ("y", "(g // 31536000)"), ("g", f"abs({gone})")):
        told = re.sub(rf"\b{name}\b(?=[ )])", value, told)
    return told


_GONE = "((event_id * 7919) % 400 - 20) * CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 ELSE 864000 END"
_events("relative_label", f"{label_sql(_GONE)} AS label", label=lambda: times.relative_label(F.expr(f"{NOW} - {_GONE}"), NOW))
_events("short_ages", f"CASE WHEN event_id % 3 = 2 THEN 0 ELSE {NOW} - (event_id % 50) * CASE event_id % 3 WHEN 0 THEN 86400 ELSE 2592000 END END AS ts",
        ts=lambda: times.short_age_ts(F.expr("CAST(event_id % 50 AS STRING) || CASE event_id % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'mo' ELSE 'x' END"), NOW))
_events("duration_label", "(floor(floor(abs(value)) / 60))::BIGINT::VARCHAR || ':' || lpad((floor(abs(value))::BIGINT % 60)::VARCHAR, 2, '0') AS label",
        label=lambda: times.duration_label(F.abs("value")))
_events("json_props", "(props->>'k')::BIGINT AS k", k=lambda: F.from_json("props", "k BIGINT")["k"])


def _json_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.to_json(F.array("url", F.lit("nowhere"))).alias("raw"))
    return rows.select("page_id", F.array_join(F.transform(urls.links_from_json(F.col("raw")), lambda x: x["host"]), "|").alias("hosts"))


QUERIES["json_links"] = _json_links
ORACLES["json_links"] = f"SELECT page_id, {_host} AS hosts FROM pages"


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "assistant", "model").otherwise("user").alias("role"), F.col("role").alias("from"), "text"
    )
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    told = F.array_sort(F.collect_list(F.when(F.col("from") == "system", F.struct("turn", "text"))))
    grouped = rows.groupBy("conv_id").agg(said.alias("said"), told.alias("told"))
    return grouped.select(
        "conv_id", F.array_join(F.transform("told", lambda x: x["text"]), "\n\n").alias("system"),
        F.array_join(F.transform("said", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("contents"),
    )


QUERIES["chat_split"] = _chat
ORACLES["chat_split"] = """SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'system'), '') AS system,
string_agg(CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END || ': ' || text, chr(10) ORDER BY turn, CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END, text) AS contents
FROM conversations GROUP BY conv_id"""
QUERIES["limit_then_filter"] = lambda s, d: (
    table(s, d, "documents").select("doc_id", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(200).where("lang = 'de'")
)
ORACLES["limit_then_filter"] = "SELECT * FROM (SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200) WHERE lang = 'de'"
QUERIES["banned_titles"] = lambda s, d: (
    table(s, d, "documents").select("doc_id", F.expr("CASE doc_id % 4 WHEN 0 THEN 'Type A' WHEN 1 THEN ' other news ' ELSE lang END").alias("t"))
    .where(~F.lower(F.btrim("t")).isin(*text.META_TITLES)).select("doc_id")
)
ORACLES["banned_titles"] = "SELECT doc_id FROM documents WHERE doc_id % 4 > 1"
