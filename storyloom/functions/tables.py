"""Table functions for SQL: the rows that a page, a mail or a model's answer holds, with LATERAL.

``register(spark)``, then ``SELECT p.page_id, l.* FROM pages p, LATERAL page_links(p.html) l``. Null gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from storyloom.functions.links import links_of
from storyloom.operators.models import META_TITLES, provider


def _one_text(given: AnalyzeArgument, *texts: str) -> AnalyzeResult:
    """A text gives rows of a number and some texts."""
    if not isinstance(given.dataType, StringType):
        raise ValueError(f"a text is wanted, not {given.dataType.simpleString()}")
    return AnalyzeResult(StructType([StructField("pos", LongType()), *[StructField(name, StringType()) for name in texts]]))


@udtf
class PageLinks:
    """(pos, anchor, href, context) of the links of a page."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        return _one_text(html, "anchor", "href", "context")

    def eval(self, html: str) -> Iterator[tuple]:
        for pos, x in enumerate(links_of(html) if html is not None else ()):
            yield pos, x["anchor"], x["href"], x["context"]


@udtf
class MailStories:
    """(pos, content_type, title, summary) of the stories that the provider finds in a mail; a second argument names the provider."""

    @staticmethod
    def analyze(body: AnalyzeArgument, name: AnalyzeArgument | None = None) -> AnalyzeResult:
        if name is not None and not name.isConstantExpression:
            raise ValueError("the provider's name is a constant")
        return _one_text(body, "content_type", "title", "summary")

    def eval(self, body: str, name: str = "offline") -> Iterator[tuple]:
        if body is None:
            return
        found = json.loads(provider(name).extract(body))
        for pos, x in enumerate(found["stories"]):
            title, summary = (x.get("title") or "").strip(" "), (x.get("summary") or "").strip(" ")
            if title and summary and title.lower() not in META_TITLES:
                yield pos, found["content_type"], title, summary


FUNCTIONS = {"page_links": PageLinks, "mail_stories": MailStories}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
