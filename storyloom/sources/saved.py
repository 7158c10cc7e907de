"""Exports of saved items: social posts and playlists as bookmarks, and the status of jobs."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from datetime import datetime, timezone
from functools import reduce

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.text import cut_title, first_line, strip
from storyloom.functions.times import duration_label, short_age_ts
from storyloom.plans.feed import or_else
from storyloom.sources.log_sink import place_of

CARD = "struct<url: string, domain: string, title: string, description: string, cover: string>"
POSTS = f"""tid string, href string, text string, authorName string, handle string, avatar string, replyTo string, dt string, articleTitle string,
  isArticle boolean, media array<struct<type: string, url: string>>, quoted struct<name: string, handle: string, text: string, cover: string>, linkCard {CARD}"""
UPDATES = f"""urn string, url string, text string, authorName string, authorTitle string, authorProfile string, avatar string, cover string, ageText string,
  linkCard {CARD}"""
VIDEOS = """id string, url string, webpage_url string, title string, uploader string, channel string, playlist_index int, duration double,
  thumbnails array<struct<url: string, width: int, height: int>>"""
STATUS = "job string, label string, status string, ok boolean, pid int, message string, started_at string, finished_at string, updated_at string, log_path string"
# Sizes in a picture's name, the first of which is replaced by the large one; jobs in their order.
AVATAR_SIZES = ("_normal", "_bigger", "_mini", "_reasonably_small")
JOBS = ("email", "telegram", "social", "youtube")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON in a given schema; lines that aren't JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def large_avatar(url: Column) -> Column:
    found = [F.when(url.contains(size), F.regexp_replace(url, rf"^(.*?){size}", "$1_400x400")) for size in AVATAR_SIZES]
    return F.coalesce(*found, url, F.lit(""))


def social_posts(rows: DataFrame) -> DataFrame:
    """Bookmarked posts in the shape of bookmarks."""
    text = _text("text")
    named = F.when(F.coalesce("isArticle", F.lit(False)) & (_text("articleTitle") != ""), F.col("articleTitle"))
    title = F.coalesce(named, F.when(text != "", first_line(text)), F.concat(F.lit("Tweet by "), or_else("handle", F.lit("unknown"))))
    with_url = F.filter("media", lambda m: F.coalesce(m["url"], F.lit("")) != "")
    return rows.select(
        F.concat(F.lit("twitter:"), "tid").alias("id"), F.lit("twitter").alias("source"),
        F.when(F.startswith(_text("href"), F.lit("/")), F.concat(F.lit("https://x.com"), "href")).otherwise(_text("href")).alias("url"),
        cut_title(title).alias("title"), F.substring(text, 1, 500).alias("excerpt"), F.coalesce(F.get(with_url, F.lit(0))["url"], F.lit("")).alias("cover"),
        strip(F.concat(_text("authorName"), F.lit(" "), _text("handle"))).alias("author"),
        F.coalesce(F.unix_timestamp(F.try_to_timestamp("dt")), F.lit(0)).alias("created_ts"), large_avatar(F.col("avatar")).alias("avatar"),
        F.to_json(F.coalesce("media", F.array().cast("array<struct<type: string, url: string>>"))).alias("media_json"),
        F.to_json("quoted").alias("quoted_json"), _text("replyTo").alias("reply_to"), F.to_json("linkCard").alias("link_card_json"),
    )


def social_updates(rows: DataFrame, now: int) -> DataFrame:
    """Saved updates of a professional network in the shape of bookmarks."""
    text, name, job = strip(_text("text")), strip(_text("authorName")), strip(_text("authorTitle"))
    title = F.when(text != "", first_line(text)).otherwise(F.concat(F.lit("Post by "), or_else(name, F.lit("unknown"))))
    return rows.select(
        F.concat(F.lit("linkedin:"), "urn").alias("id"), F.lit("linkedin").alias("source"),
        or_else("url", F.concat(F.lit("https://www.linkedin.com/feed/update/"), "urn", F.lit("/"))).alias("url"), cut_title(title).alias("title"),
        F.substring(text, 1, 800).alias("excerpt"), F.coalesce(or_else("cover", "linkCard.cover"), F.lit("")).alias("cover"),
        F.when(job != "", F.concat(name, F.lit(" — "), job)).otherwise(name).alias("author"), short_age_ts(_text("ageText"), now).alias("created_ts"),
        _text("avatar").alias("avatar"), F.lit("[]").alias("media_json"), F.lit(None).cast("string").alias("quoted_json"), F.lit("").alias("reply_to"),
        F.to_json("linkCard").alias("link_card_json"),
    )


def playlist_items(rows: DataFrame, now: int) -> DataFrame:
    """Playlist entries in the shape of bookmarks; entries without an id are left out."""
    area = lambda t: F.coalesce(t["width"], F.lit(0)).cast("long") * F.coalesce(t["height"], F.lit(0))
    ranked = F.transform("thumbnails", lambda t, i: F.struct(area(t).alias("area"), (-i).alias("first"), t["url"].alias("url")))
    thumb = or_else(F.array_max(ranked)["url"], F.concat(F.lit("https://i.ytimg.com/vi/"), "id", F.lit("/hqdefault.jpg")))
    uploader = strip(F.coalesce(or_else("uploader", "channel"), F.lit("")))
    length = F.when(F.coalesce("duration", F.lit(0.0)) > 0, duration_label(F.col("duration")))
    excerpt = F.coalesce(F.when(uploader != "", F.concat(uploader, F.lit(" · "), length)), length, uploader)
    rank = F.coalesce("playlist_index", F.lit(0)).cast("long")
    return rows.where(_text("id") != "").select(
        F.concat(F.lit("youtube:"), "id").alias("id"), F.lit("youtube").alias("source"),
        or_else("url", "webpage_url", F.concat(F.lit("https://www.youtube.com/watch?v="), "id")).alias("url"),
        or_else(strip(_text("title")), F.lit("(untitled)")).alias("title"), excerpt.alias("excerpt"), thumb.alias("cover"), uploader.alias("author"),
        (F.lit(now) - F.greatest(rank - 1, F.lit(0))).alias("created_ts"), F.lit("watch later").alias("tags"), rank.alias("source_rank"),
    )


def job_statuses(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One row for each job of (job -> path of its status file), in the jobs' order.

    Fields that a file lacks have defaults; a file that is missing means idle, one that can't be read unknown.
    """
    rows = []
    for job, path in paths.items():
        try:
            found = spark.read.schema(STATUS).option("multiLine", True).option("mode", "PERMISSIVE").json(path).limit(1)
            found = found.withColumn("status", F.coalesce("status", F.lit("unknown")))
            found.schema  # noqa: B018
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = spark.createDataFrame([(job, job, "idle", None, None, None, None, None, None, path)], STATUS)
        rows.append(found.withColumns({"job": F.lit(job), "label": F.coalesce("label", F.lit(job)), "ok": F.coalesce("ok", F.col("status").isin("idle", "running", "success"))}))
    place = F.array_position(F.array(*[F.lit(j) for j in JOBS]), F.col("job"))
    return reduce(DataFrame.unionByName, rows).orderBy(F.when(place == 0, 99).otherwise(place), "job")


@contextmanager
def job_status(path: str, job: str, label: str | None = None) -> Iterator[dict]:
    """The status file of a job while it runs: running, then success or failed, each put in place whole.

    The yielded fields (``message``, say) go into the last status. A failure is written with its text and raised again;
    ``started_at`` stays, and the finish time of the run before stays until this one ends.
    """
    place, file = place_of(path)
    now = lambda: datetime.now(timezone.utc).isoformat()
    told = {"job": job, "label": label or job, "started_at": now(), "pid": os.getpid(), "finished_at": None}
    if place.get_file_info(file).type != fs.FileType.NotFound:
        with place.open_input_stream(file) as source:
            with suppress(ValueError):
                told["finished_at"] = json.loads(source.read()).get("finished_at")

    def write(**facts) -> None:  # noqa: ANN003
        place.create_dir(file.rpartition("/")[0], recursive=True)
        aside = f"{file}.{uuid.uuid4().hex}"
        with place.open_output_stream(aside) as out:
            out.write(json.dumps(told | facts | {"updated_at": now()}).encode())
        place.move(aside, file)

    write(status="running", ok=True)
    try:
        yield told
    except BaseException as error:
        write(status="failed", ok=False, finished_at=now(), message=str(error) or type(error).__name__)
        raise
    write(status="success", ok=True, finished_at=now())
