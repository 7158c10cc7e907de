"""Mail messages saved as JSON: headers, MIME parts, bodies and links as a newsletter table."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.links import links_in_context
from storyloom.functions.slices import by_slices
from storyloom.functions.text import clean_html, normalize_lines, preferred_body, skip_email, strip, unescape_html

SHORTEST_BODY = 50
_BODIES = T.StructType([T.StructField(name, T.StringType()) for name in ("plain", "rich", "first_html")])


def _decoded(part: dict) -> str:
    data = "".join(((part.get("body") or {}).get("data") or "").split()).replace("-", "+").replace("_", "/").rstrip("=")
    return base64.b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace") if data else ""


def bodies_of(payload: dict) -> tuple[str, str, str]:
    """(plain, html, first html in depth order) of a tree of MIME parts.

    A node's own data comes first. Among the parts of a node the last of each type counts; parts of parts are
    looked at only as long as there is no plain text.
    """
    own = _decoded(payload)
    kind = payload.get("mimeType") or ""
    if own:
        return ("", own, own) if kind == "text/html" else (own, "", "")
    plain = rich = first = ""
    for part in payload.get("parts") or []:
        data, kind = _decoded(part), part.get("mimeType") or ""
        if kind == "text/plain" and data:
            plain = data
        elif kind == "text/html" and data:
            rich, first = data, first or data
        elif part.get("parts"):
            below = bodies_of(part)
            first = first or below[2]
            if not plain:
                plain, rich = below[0], rich or below[1]
    return plain, rich, first


def _bodies(payloads: pa.Array) -> pa.Array:
    rows = []
    for payload in payloads:
        try:
            text = payload.as_py()
            rows.append(bodies_of(json.loads(text)) if text else ("", "", ""))
        except (ValueError, AttributeError, TypeError):
            rows.append((None, None, None))
    return pa.StructArray.from_arrays([pa.array([row[k] for row in rows], pa.string()) for k in range(3)], ["plain", "rich", "first_html"])


@F.arrow_udf(_BODIES)
def mime_bodies(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The bodies of payloads given as JSON text; MIME trees are recursive, which no column type is."""
    return by_slices(_bodies)(columns)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(id, snippet, payload) of messages saved one per line; the payload stays JSON text."""
    lines = spark.read.text(path)
    return lines.select(*[F.get_json_object("value", f"$.{name}").alias(name) for name in ("id", "snippet", "payload")])


def newsletters(messages: DataFrame) -> DataFrame:
    """(id, subject, sender, date, body, snippet, gmail_url, links, outcome) of messages.

    ``outcome`` is ok, skipped (no newsletter by its headers), short or broken; only ok rows have a body. Rows
    with any outcome are to be marked as seen. Of skipped mails nothing but the headers is decoded.
    """
    entries = F.from_json(F.get_json_object("payload", "$.headers"), "array<struct<name: string, value: string>>")
    headers = F.transform(F.coalesce(entries, F.array().cast("array<struct<name: string, value: string>>")), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    rows = messages.withColumn("h", headers)
    last = lambda name: F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter("h", lambda x: x["name"] == name), lambda x: F.coalesce(x["value"], F.lit("")))), -1)
    names = F.array_distinct(F.transform("h", lambda x: x["name"]))
    as_map = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter("h", lambda x: x["name"] == n), -1)["value"]))
    rows = rows.select("id", "snippet", "payload", last("subject").alias("subject"), last("from").alias("sender"), last("date").alias("date"), as_map.alias("headers"))
    rows = rows.withColumn("skip", F.coalesce(skip_email(F.col("subject"), F.col("sender"), F.col("headers")), F.lit(False)))
    link = F.concat(F.lit("https://mail.google.com/mail/u/0/#inbox/"), F.col("id")).alias("gmail_url")
    # One pass: a filter on ``skip`` would be moved below the headers and read them anew for each time it names them.
    rows = rows.withColumn("m", mime_bodies(F.when(~F.col("skip"), F.col("payload"))))
    # Both bodies are columns of their own, so that each is cleaned once, however often it is asked about.
    rows = rows.withColumns({"plain": F.coalesce("m.plain", F.lit("")), "rich": clean_html(F.coalesce("m.rich", F.lit("")))})
    better = preferred_body(F.col("plain"), F.col("rich"))
    body = F.when(F.col("m.rich") == "", F.col("plain")).when(F.col("m.plain") == "", F.col("rich")).otherwise(better)
    rows = rows.withColumn("body", normalize_lines(unescape_html(body)))
    outcome = (
        F.when(F.col("skip"), "skipped").when(F.col("m.plain").isNull(), "broken")
        .when(F.length(strip(F.coalesce("body", F.lit("")))) < SHORTEST_BODY, "short").otherwise("ok")
    )
    rows = rows.withColumn("outcome", outcome)
    ok = F.col("outcome") == "ok"
    return rows.select(
        "id", "subject", "sender", "date", F.when(ok, F.col("body")).alias("body"), "snippet", link,
        F.when(ok, links_in_context("m.first_html")).alias("links"), "outcome",
    )
