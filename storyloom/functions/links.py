"""Links of HTML pages: anchors with context, resolution against the page, and the link that fits a story best."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.slices import by_slices
from storyloom.functions.text import link_score, word_set
from storyloom.functions.urls import host_of, is_bad_url, is_shortener, is_wrapper_host
from storyloom.operators.graph import cut
from storyloom.operators.joins import join_counted

# How much raw and clean text around an anchor is its context.
RAW_CONTEXT, CONTEXT = 1500, 300
LINK = T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in ("anchor", "href", "context")]))
OPENS, TARGET, CLOSES, QUOTE = re.compile(r"(?i)<a\s"), re.compile(r"(?i)href\s*=\s*[\"'](?=[^\"'])"), re.compile(r"(?i)</a>"), re.compile("[\"']")
HIDDEN = {name: (re.compile(f"(?i)<{name}"), re.compile(f"(?i)</{name}>")) for name in ("style", "script")}


def without_code(markup: str) -> str:
    """The markup without styles and scripts; one that isn't closed stays, and ends the search."""
    for opens, closes in HIDDEN.values():
        out, at = [], 0
        while (start := opens.search(markup, at)) and (inside := markup.find(">", start.end())) >= 0 and (end := closes.search(markup, inside + 1)):
            out.append(markup[at : start.start()])
            at = end.end()
        markup = "".join([*out, markup[at:]])
    return markup


def _plain(markup: str) -> str:
    """Tags and runs of white space as one blank each."""
    out, at = [], 0
    while (start := markup.find("<", at)) >= 0 and (end := markup.find(">", start + 2)) >= 0:
        out += [markup[at:start], " "]
        at = end + 1
    return re.sub(r"\s+", " ", "".join([*out, markup[at:]]))


class Anchors:
    """The anchors of a piece of markup: spans and targets.

    Places of targets, quotes and closing tags are listed once; an opening tag then takes the last target that
    begins within it, and its text ends with the next closing tag. So a page is read in a few passes whatever is
    open or broken in it.
    """

    def __init__(self, markup: str):
        self.markup = markup
        self.targets = [m.span() for m in TARGET.finditer(markup)]
        self.starts = [start for start, _ in self.targets]
        self.closes = [m.span() for m in CLOSES.finditer(markup)]
        self.closing = [start for start, _ in self.closes]

    def _at(self, start: int) -> tuple[int, int, str, str] | None:
        """(start, end, target, inner markup) of the anchor that opens at a place."""
        tag_end = self.markup.find(">", start)
        for k in range(bisect_right(self.starts, tag_end) - 1, bisect_left(self.starts, start + 3) - 1, -1):
            begin = self.targets[k][1]
            if begin <= tag_end and (quote := QUOTE.search(self.markup, begin)) and (inside := self.markup.find(">", quote.end())) >= 0:
                close = bisect_left(self.closing, inside + 1)
                if close < len(self.closes):
                    return start, self.closes[close][1], self.markup[begin : quote.start()], self.markup[inside + 1 : self.closes[close][0]]
        return None

    def __iter__(self) -> Iterator[tuple[int, int, str, str]]:
        opening = OPENS.search(self.markup)
        while opening and self.closing and opening.start() < self.closing[-1]:
            found = self._at(opening.start())
            if found:
                yield found
            opening = OPENS.search(self.markup, found[1] if found else opening.end())


def links_of(markup: str | None) -> list[dict[str, str]]:
    """(anchor, href, context) of each link with a target."""
    markup, found = without_code(markup or ""), []
    for start, end, href, inner in Anchors(markup):
        if href.strip():
            anchor = _plain(inner).strip()
            before, after = _plain(markup[max(0, start - RAW_CONTEXT) : start]), _plain(markup[end : end + RAW_CONTEXT])
            found.append({"anchor": anchor, "href": href.strip(), "context": f"{before[-CONTEXT:]} {anchor} {after[:CONTEXT]}".strip()})
    return found


@F.arrow_udf(LINK)
def links_in_context(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The links of each page; places of matches are beyond built-in functions."""
    kind = pa.list_(pa.struct([(name, pa.string()) for name in ("anchor", "href", "context")]))
    return by_slices(lambda markup: pa.array([links_of(x) for x in markup.to_pylist()], kind))(columns)


def absolute(href: Column, page_url: Column) -> Column:
    """A link resolved against its page: full links as they are, rooted ones below the page's host."""
    root = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^?#]*/)", 1)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(page_url, "^([^:]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(root, F.lit("/"))), href))
    )


def primary_links(
    stories: DataFrame, links: DataFrame, least: int = 2, sender_host: str | None = None, targets: DataFrame | None = None
) -> DataFrame:
    """(story_id, primary_url) by the words that a story shares with its source's links.

    ``stories`` has story_id, source_id, title, summary; ``links`` has source_id, pos, anchor, href, context.
    Bad links don't count. The best score wins, then the longer anchor, then the first. The winner is followed
    through ``targets`` (url, target), and a story whose winner then is bad or still a wrapper has no link. Words of
    a story are made once, before the join.
    """
    own = F.lit(sender_host) if sender_host else None
    told = stories.select("story_id", "source_id", word_set(F.concat_ws(" ", "title", F.substring("summary", 1, 220))).alias("w"))
    usable = links.where(~is_bad_url(F.col("href"), own))
    scored = told.where(F.size("w") > 0).join(usable, "source_id").withColumn("score", link_score(F.col("w"), F.col("anchor"), F.col("context")))
    best = F.max_by("href", F.struct("score", F.length("anchor"), -F.col("pos")))
    won = scored.where(F.col("score") >= least).groupBy("story_id").agg(best.alias("url"))
    won = resolve(won, targets) if targets is not None else won.withColumn("resolved", F.col("url"))
    good = ~is_bad_url(F.col("resolved"), own) & ~is_wrapper_host(host_of(F.col("resolved")))
    return won.where(good).select("story_id", F.col("resolved").alias("primary_url"))


def resolve(urls: DataFrame, targets: DataFrame, hops: int = 2) -> DataFrame:
    """``urls`` (url) with ``resolved``: short and wrapped links followed through a table (url, target).

    Of several targets of one link the first in byte order is taken, so a row stays one row; a link without a
    target, or with a null one, stays. Distinct links are followed and joined back by counts, so a link that a
    third of all rows have is one step and no single task's work.
    """
    step = targets.where(F.col("url").isNotNull() & F.col("target").isNotNull()).groupBy("url").agg(F.min("target").alias("_to"))
    step = step.withColumnRenamed("url", "_from")
    short = lambda c: is_shortener(host_of(F.col(c))) | is_wrapper_host(host_of(F.col(c)))
    found = cut(urls.where(short("url")).groupBy("url").agg(F.count("*").alias("n")))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = found.withColumn("resolved", F.col("url"))
    for _ in range(hops):
        found = found.join(step, short("resolved") & (F.col("resolved") == F.col("_from")), "left")
        found = found.withColumn("resolved", F.coalesce("_to", "resolved")).drop("_from", "_to")
    told = join_counted(urls.where(short("url")), cut(found), "url", total)
    rest = urls.where(~F.coalesce(short("url"), F.lit(False))).withColumn("resolved", F.col("url"))
    return told.select(*urls.columns, "resolved").unionByName(rest.select(*urls.columns, "resolved"))
