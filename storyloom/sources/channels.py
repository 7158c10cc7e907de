"""Pages of public channels: one row per post."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.slices import by_slices
from storyloom.functions.text import content_hash, needs_translation, title_of
from storyloom.functions.urls import clean_post_link, is_roundup, is_sponsored

# The class names of a channel page.
WRAP, DATE, TEXT, PREVIEW = ("tgme_widget_message_wrap", "tgme_widget_message_date", "tgme_widget_message_text", "tgme_widget_message_link_preview")
PHOTO, VIDEO = "tgme_widget_message_photo_wrap", ("tgme_widget_message_video_thumb", "tgme_widget_message_video_wrap")
PICTURE = re.compile(r"background-image:\s*url\(['\"]?([^'\")]+)")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
POST = T.ArrayType(
    T.StructType(
        [T.StructField("url", T.StringType()), T.StructField("date", T.StringType()), T.StructField("text", T.StringType())]
        + [T.StructField(name, T.ArrayType(T.StringType())) for name in ("hrefs", "previews", "images", "video_thumbs")]
    )
)


class _Posts(HTMLParser):
    """Collects what belongs to each post; a stack of open tags tells where one ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.posts: list[dict] = []
        self.stack: list[tuple[str, str]] = []
        self.post: dict | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        classes = given.get("class", "").split()
        if WRAP in classes and self.post is None:
            self.post = {"url": None, "date": None, "text": [], "has_text": False, "hrefs": [], "previews": [], "images": [], "video_thumbs": []}
            self.stack = []
        if self.post is not None:
            role = "wrap" if WRAP in classes else "text" if TEXT in classes and not self.post["has_text"] else ""
            if role == "text":
                self.post["has_text"] = True
            if DATE in classes and self.post["url"] is None:
                self.post["url"] = given.get("href", "")
            if tag == "time" and "datetime" in given and self.post["date"] is None:
                self.post["date"] = given["datetime"]
            if tag == "a" and "href" in given and any(r == "text" for _, r in self.stack):
                self.post["hrefs"].append(given["href"])
            if PREVIEW in classes and "href" in given and not self.post["previews"]:
                self.post["previews"].append(given["href"])
            if found := PICTURE.search(given.get("style", "")):
                if PHOTO in classes:
                    self.post["images"].append(found[1])
                if any(v in classes for v in VIDEO):
                    self.post["video_thumbs"].append(found[1])
            if tag not in VOID:
                self.stack.append((tag, role))

    def handle_endtag(self, tag: str) -> None:
        if self.post is None or tag not in [t for t, _ in self.stack]:
            return
        while self.stack:
            open_tag, _ = self.stack.pop()
            if open_tag == tag:
                break
        if not self.stack:
            self.posts.append(self.post)
            self.post = None

    def handle_data(self, data: str) -> None:
        if self.post is not None and data.strip() and any(r == "text" for _, r in self.stack):
            self.post["text"].append(data.strip())


@F.arrow_udf(POST)
def page_posts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The posts of each page; HTML is beyond built-in functions."""
    texts = [(n, pa.string()) for n in ("url", "date", "text")]
    kind = pa.list_(pa.struct(texts + [(n, pa.list_(pa.string())) for n in ("hrefs", "previews", "images", "video_thumbs")]))
    told = lambda x: [dict(zip(kind.value_type.names, post, strict=True)) for post in posts_of(x)]
    return by_slices(lambda pages: pa.array([told(x) for x in pages.to_pylist()], kind))(columns)


def posts_of(markup: str | None) -> list[tuple]:
    """(url, date, text, hrefs, previews, images, video thumbs) of a page's posts that have a number."""
    parser = _Posts()
    parser.feed(markup or "")
    if parser.post is not None:
        parser.posts.append(parser.post)
    return [
        (p["url"], p["date"], "\n".join(p["text"]), p["hrefs"], p["previews"], p["images"], p["video_thumbs"])
        for p in parser.posts
        if p["url"] is not None and re.fullmatch(r"\d+", urlsplit(p["url"]).path.strip("/").split("/")[-1]) and urlsplit(p["url"]).path.strip("/").count("/")
    ]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(channel, html) of saved pages; the channel is the name of the file's folder."""
    pages = spark.read.text(path, wholetext=True)
    return pages.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1).alias("channel"), F.col("value").alias("html"))


def posts(pages: DataFrame, now_text: str) -> DataFrame:
    """(id, channel, msg_id, url, date, text, links, images, video_thumbs, is_sponsored, is_digest), each post once.

    A post that pages show in several forms is taken in the longest text, of equally long ones in the first by its fields.
    """
    rows = pages.select("channel", F.explode(page_posts("html")).alias("p")).select("channel", "p.*")
    own = F.filter(F.transform("hrefs", clean_post_link), lambda x: x.isNotNull())
    preview = F.filter(F.transform("previews", clean_post_link), lambda x: x.isNotNull())
    links = F.array_distinct(F.concat(F.array_except(preview, own), own))
    number = F.regexp_extract("url", r"(\d+)/?(?:[?#].*)?$", 1).cast("long")
    found = rows.select(
        F.concat(F.lit("tg:"), "channel", F.lit(":"), number.cast("string")).alias("id"), "channel", number.alias("msg_id"), "url",
        F.coalesce("date", F.lit(now_text)).alias("date"), "text", links.alias("links"), "images", "video_thumbs",
    )
    others = [c for c in found.columns if c != "id"]
    one = found.groupBy("id").agg(F.min(F.struct((-F.length("text")).alias("_shorter"), *others)).alias("t")).select("id", *[f"t.{c}" for c in others])
    return one.withColumns({"is_sponsored": is_sponsored(F.col("links")), "is_digest": is_roundup(F.col("links"))})


def since(rows: DataFrame, ts: int) -> DataFrame:
    """Posts from a time on; those without a readable date stay."""
    at = F.unix_timestamp(F.try_to_timestamp("date"))
    return rows.where(F.coalesce(at >= ts, F.lit(True)))


def post_stories(rows: DataFrame) -> DataFrame:
    """Posts as stories with ``outcome``: dropped (ads and roundups), empty (pictures only) or story."""
    outcome = F.when(F.col("is_sponsored") | F.col("is_digest"), "dropped").when(F.trim("text") == "", "empty").otherwise("story")
    return rows.select(
        "id", outcome.alias("outcome"), title_of(F.col("text"), F.concat(F.lit("@"), "channel", F.lit(" post"))).alias("title"), F.col("text").alias("summary"),
        F.coalesce(F.get("links", F.lit(0)), F.col("url")).alias("primary_url"), F.concat(F.lit("@"), "channel").alias("sender"), "url", "date",
        F.coalesce(F.get("images", F.lit(0)), F.get("video_thumbs", F.lit(0)), F.lit("")).alias("primary_image_url"),
        content_hash(F.col("text")).alias("content_hash"), needs_translation(F.col("text")).alias("needs_translation"), "links",
    )
