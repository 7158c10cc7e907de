"""Queries of streams, paged scans and compacted logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import tables, text
from storyloom.operators import answers, graph, kept_counts, state
from storyloom.plans import feed, feed_queries, search_index, story_queries, text_queries, views
from storyloom.plans.views import NOW
from storyloom.session import table
from storyloom.sources import log_sink, paged
from storyloom.streaming import hashes, ingest, stories
from storyloom.streaming.store import BatchStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{graph.shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _in_parts(rows: DataFrame, key: str, parts: int) -> list[DataFrame]:
    """The rows in ranges of a key, in its order."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return [rows]
    step = (high - low) // parts + 1
    return [rows.where((F.col(key) >= low + k * step) & (F.col(key) < low + (k + 1) * step)) for k in range(parts)]


# --- stories and hashes -----------------------------------------------------------------------------------------------


def _persisted(spark: SparkSession, sf_dir: str) -> stories.StoryStore:
    """The items of ``persist_stories`` in three runs of a stream, each in one transaction."""
    new, old, vectors, embed = story_queries.begun(spark, sf_dir)
    folder = _folder(spark, "stories")
    store = stories.StoryStore(spark, f"{folder}/store")
    store.begin(old, vectors)
    for part in _in_parts(new, "id", 3):
        part.write.mode("append").parquet(f"{folder}/items.parquet")
        items = ingest.stream_table(spark, folder, "items")
        stories.persist_stream(items, store, f"{folder}/checkpoint", embed, story_queries.check, lambda _: NOW, story_queries.THRESHOLD, exact=True)
    return store


_register("stream_persist", lambda s, d: _persisted(s, d).stories(), story_queries.ORACLES["persist_stories"])
_register("stream_persist_mentions", lambda s, d: _persisted(s, d).read("mentions").select("id", "story_id", "added_new_info"), story_queries.ORACLES["persist_mentions"])


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by content hash in two runs of a stream; those of every seventh were known before."""
    folder = _folder(spark, "hashes")
    rows = graph.cut(table(spark, sf_dir, "documents").select("doc_id", text.content_hash(text_queries.linked()).alias("hash")))
    known = rows.where("doc_id % 7 = 0").select("hash")
    for part in _in_parts(rows, "doc_id", 2):
        part.write.mode("append").parquet(f"{folder}/rows.parquet")
        told = hashes.stream_first_by_hash(ingest.stream_table(spark, folder, "rows"), "hash", "doc_id", F.col("doc_id") % 3 != 0, known)
        found = ingest.run_once(told, "append", f"{folder}/checkpoint", f"{folder}/out")
    return found.select(F.col("place").alias("doc_id"), "status")


_register(
    "stream_first_by_hash", _hashed,
    f"""WITH d AS (SELECT doc_id, {text_queries.HASH_SQL} AS h FROM documents),
    k AS (SELECT DISTINCT h FROM d WHERE doc_id % 7 = 0), f AS (SELECT h, min(doc_id) AS first FROM d WHERE doc_id % 3 <> 0 GROUP BY h)
    SELECT doc_id, CASE WHEN h = '' THEN 'empty' WHEN h IN (SELECT h FROM k) THEN 'duplicate' WHEN first IS NULL OR doc_id < first THEN 'retry'
      WHEN doc_id = first THEN 'new' ELSE 'duplicate' END AS status FROM d LEFT JOIN f USING (h)""",
)

# --- paged scans ------------------------------------------------------------------------------------------------------

_AT = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"


def _pages(events: DataFrame, path: str) -> None:
    """Events as the saved pages of a service: a channel for each type, a page for each day."""
    rows = events.select(
        F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("date"), F.col("props").alias("text"),
        F.col("event_type").alias("channel"), F.date_format("ts", "yyyy-MM-dd").alias("page"),
    )
    rows.repartition("channel", "page").write.partitionBy("channel", "page").mode("append").json(path)


def _scan(spark: SparkSession, path: str, events: DataFrame):  # noqa: ANN202
    spark.dataSource.register(paged.PagedItems)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    channels = ",".join(sorted(r[0] for r in events.select("event_type").distinct().collect()))
    return {"client": "storyloom.sources.paged:SavedPages", "path": path, "channels": channels, "all": "1"}


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items from the twentieth on; pages before the day that the filter needs aren't read."""
    events, path = table(spark, sf_dir, "events"), _folder(spark, "pages")
    _pages(events, path)
    items = spark.read.format("paged_items").options(**_scan(spark, path, events)).load()
    return items.where("date >= '2024-01-20T00:00:00.000000Z'").select("id", "channel", "date")


_register("paged_scan", _paged, f"SELECT event_id::VARCHAR AS id, event_type AS channel, {_AT} AS date FROM events WHERE ts >= TIMESTAMP '2024-01-20'")


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred items of all channels together."""
    events, path = table(spark, sf_dir, "events"), _folder(spark, "pages")
    _pages(events, path)
    items = spark.read.format("paged_items").options(**_scan(spark, path, events), limit="100").load()
    return paged.newest(items, 100).select("id", "channel", "date")


_register("paged_newest", _newest, f"SELECT event_id::VARCHAR AS id, event_type AS channel, {_AT} AS date FROM events ORDER BY ts DESC, event_type, id LIMIT 100")


def _paged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, the second after the second half of the events came; every item arrives once."""
    events, path, folder = table(spark, sf_dir, "events"), _folder(spark, "pages"), _folder(spark, "paged")
    middle = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    for part in (events.where(middle), events.where(~middle)):
        _pages(part, path)
        items = spark.readStream.format("paged_items").options(**_scan(spark, path, events)).load()
        found = ingest.run_once(items, "append", f"{folder}/checkpoint", f"{folder}/out")
    return found.select("id", "channel", "date")


_register("paged_stream", _paged_stream, f"SELECT event_id::VARCHAR AS id, event_type AS channel, {_AT} AS date FROM events")

# --- logs -------------------------------------------------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> BatchStore:
    """Snapshots of saved items in five batches, compacted after the second and the fourth."""
    rows = views.snapshots(spark, sf_dir)
    store = BatchStore(spark, _folder(spark, "log"), {"log": ingest.columns_of(rows)})
    for number, part in enumerate(_in_parts(rows, "seen_seq", 5)):
        store.commit(number, {"log": part})
        if number in (1, 3):
            store.compact(number, {"log": lambda r: state.still_needed(r, "id", "seen_seq")})
    return store


_register("compacted_social", lambda s, d: state.bookmark_snapshots(_log(s, d).read("log").drop("batch", "source_rank")), feed_queries.ORACLES["upsert_social"])
_register("compacted_playlist", lambda s, d: state.playlist_snapshots(_log(s, d).read("log").drop("batch")), feed_queries.ORACLES["upsert_playlist"])
_register(
    "social_as_of", lambda s, d: state.bookmark_snapshots(_log(s, d).read("log", 2).drop("batch", "source_rank")),
    feed_queries.ORACLES["upsert_social"].replace(
        "FROM snapshots GROUP BY id", "FROM snapshots WHERE seen_seq < (SELECT min(seen_seq) + 3 * ((max(seen_seq) - min(seen_seq)) // 5 + 1) FROM snapshots) GROUP BY id"
    ),
)


def _sunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots written to a log in three named writes, the second twice, as a run that isn't sure of its first try would."""
    spark.dataSource.register(log_sink.UpsertLog)
    path = _folder(spark, "sink")
    parts = _in_parts(views.snapshots(spark, sf_dir).drop("source_rank"), "seen_seq", 3)
    for number in (0, 1, 1, 2):
        if number < len(parts):
            parts[number].write.format("upsert_log").option("path", path).option("batch", f"run-{number}").mode("append").save()
    return state.bookmark_snapshots(spark.read.format("upsert_log").option("path", path).load())


_register("sink_social", _sunk, feed_queries.ORACLES["upsert_social"])

# --- kept counts ------------------------------------------------------------------------------------------------------


def _flipped(rows: DataFrame, spark: SparkSession, counts: kept_counts.KeptCounts) -> kept_counts.KeptCounts:
    """All rows with flags that are partly wrong, then ten batches that set them right, the fourth one taken in twice."""
    rows = graph.cut(rows)
    wrong = F.col("id") % 3 == 0
    counts.apply(rows.withColumns({f: F.when(wrong, ~F.col(f)).otherwise(F.col(f)) for f in ("skipped", "is_read") if f in rows.columns}), 0)
    for number in range(1, 11):
        counts.apply(rows.where(wrong & (F.floor(F.col("id") / 3) % 10 == number - 1)), number)
        if number == 4:
            counts.apply(rows.where(wrong), number)
        if number == 6:
            counts.shorten(number)
    return counts


def _facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed_queries.base(spark, sf_dir).select("id", "source_type", "skipped")
    kept = kept_counts.KeptCounts(spark, _folder(spark, "facets"), "id long, source_type string, skipped boolean", kept_counts.facet)
    return kept_counts.facets(_flipped(rows, spark, kept).counts())


_register("kept_facets", _facets, feed_queries.ORACLES["facets"])


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.stories(spark, sf_dir).select("id", "new_info_count", "is_read", "last_updated")
    kept = kept_counts.KeptCounts(spark, _folder(spark, "stats"), "id long, new_info_count long, is_read boolean, last_updated long", kept_counts.story_stats)
    return kept_counts.stats(_flipped(rows, spark, kept).counts(), NOW)


_register("kept_stats", _stats, feed_queries.ORACLES["stats"].replace(",\n    (SELECT count(*) FROM mentions) AS mentions FROM stories", " FROM stories"))

# --- models and tables in SQL -----------------------------------------------------------------------------------------


def _unsure() -> Callable[[str], str]:
    """A model that answers with the length of a prompt and fails on some."""

    def call(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise RuntimeError("overloaded")
        return f"{len(prompt)} characters"

    return call


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each document as a prompt, asked in two runs; the second asks again for what failed only."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("prompt"))
    store = answers.AnswerStore(spark, _folder(spark, "answers"), "large")
    for _ in range(2):
        store.ask(rows, _unsure)
    return store.answered(rows).drop("prompt")


_register(
    "answers_once", _answered,
    """SELECT doc_id, CASE WHEN length(p) % 7 <> 0 THEN length(p) || ' characters' END AS answer, CASE WHEN length(p) % 7 = 0 THEN 'RuntimeError: overloaded' END AS error
    FROM (SELECT doc_id, string_split(text, chr(10))[1] AS p FROM documents)""",
)


def _links_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    return spark.sql("SELECT p.page_id, l.pos, l.anchor, l.href FROM {pages} p, LATERAL page_links(p.html) l", pages=table(spark, sf_dir, "pages"))


_register("page_links_in_sql", _links_in_sql, text_queries.ORACLES["page_links"])


def _stories_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    mails = story_queries.mails(spark, sf_dir)
    return spark.sql("SELECT m.id, s.pos, s.content_type, s.title, s.summary, false AS failed FROM {mails} m, LATERAL mail_stories(m.body) s", mails=mails)


_register("extract_stories_in_sql", _stories_in_sql, story_queries.ORACLES["extract_stories"])


# --- words ------------------------------------------------------------------------------------------------------------


def _indexed(q: str) -> Query:
    """The feed's rows for a query, through an index that took them in two batches."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = graph.cut(feed_queries.base(spark, sf_dir))
        index = search_index.SearchIndex(spark, _folder(spark, "words"))
        for number in (0, 1):
            index.add(rows.where(F.col("id") % 2 == number), number)
        return feed_queries.shown(feed.ordered(feed.filtered(rows, q, index=index), "recent", NOW))

    return query


for _name, _q in (("word", "the"), ("phrase", '"of the"'), ("neg", "-and"), ("combo", "the -source:email age:<=1mo is:unread")):
    _register(f"q_{_name}_indexed", _indexed(_q), feed_queries.ORACLES[f"q_{_name}"])
