"""Text, URL, time and link functions on cases written by hand."""

from __future__ import annotations

import hashlib
import random
import re
import time
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from storyloom.functions import links, text, times, urls

NOW = 1_706_659_200


def one(spark, column, **values):
    """The value of an expression over one row."""
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("url", "host"),
    [("https://www.Example.org:8080/a?b", "example.org:8080"), ("http://www.www.x.org", "www.x.org"), ("mailto:a@b", ""), ("", ""), (None, ""),
     ("https://u@h.org#f", "u@h.org"), ("https://a.org?x=a|b", "a.org")],
)
def test_host(spark, url, host):
    assert one(spark, urls.host_of(F.col("u")), u=url) == host


@pytest.mark.parametrize(
    ("url", "own", "bad"),
    [("https://a.org/x", "", False), ("ftp://a.org", "", True), ("https://a.org/Unsubscribe", "", True), ("https://news.b.org/x", "b.org", True),
     ("https://b.org/x", "b.org", True), ("https://ab.org/x", "b.org", False)],
)
def test_bad_url(spark, url, own, bad):
    assert one(spark, urls.is_bad_url(F.col("u"), F.col("o")), u=url, o=own) is bad


def test_post_links(spark):
    given = ["?q=a", "/x", "https://t.me/c", "https://a.org/1?erid=5", "https://www.a.org/2", "https://b.org", "https://x.com/y", "https://c.org"]
    kept = F.filter(F.transform("l", urls.clean_post_link), lambda x: x.isNotNull())
    assert one(spark, kept, l=given) == given[3:]
    assert one(spark, urls.is_sponsored(F.col("l")), l=given) is True
    assert one(spark, urls.is_roundup(F.col("l")), l=given[3:]) is True
    assert one(spark, urls.is_roundup(F.col("l")), l=given[3:7]) is False


def test_links_json(spark):
    assert one(spark, urls.links_from_json(F.col("r")), r="no json") == []
    assert [x["host"] for x in one(spark, urls.links_from_json(F.col("r")), r='["https://a.org/x", "nowhere", null, 5]')] == ["a.org"]


def test_normalize(spark):
    given = "Hi​  there\r\n\r\n\r\n\r\nnext　line\n========\n---\n" + "¬ " * 9 + "end\n "
    assert one(spark, text.normalize_lines(F.col("t")), t=given) == "Hi there\n\nnext line\n---\nend"
    assert one(spark, text.normalize_lines(F.col("t")), t="Привет, как дела\nok") == "ok"
    assert one(spark, text.normalize_lines(F.col("t"), keep_other_scripts=True), t="Привет, как дела\nok") == "Привет, как дела\nok"


def test_clean_html_decodes_in_order(spark):
    given = "<style>p{}</style><p>a&amp;lt;b</p><script>x</script><div>c<br/>d</div>\n \n\n<b>e</b>"
    assert one(spark, text.clean_html(F.col("t")), t=given) == "a<b\nc\nd\n\ne"


def test_mail_rules(spark):
    skip = lambda subject, sender: one(spark, text.skip_email(F.col("a"), F.col("b")), a=subject, b=sender)
    assert skip("Your footprint", "news@x.org") is True  # the part "otp"
    assert skip("News", "noreply@substack.com") is False
    assert skip("News", "noreply@x.org") is True
    assert skip("Re: hi", "a@x.org") is True
    headers = F.create_map(F.lit("subject"), F.lit("x"))
    assert one(spark, text.skip_email(F.lit("Account news"), F.lit("a@b.c"), headers)) is True
    listed = F.create_map(F.lit("precedence"), F.lit("Bulk"))
    assert one(spark, text.skip_email(F.lit("Account news"), F.lit("a@b.c"), listed)) is False


def test_titles(spark):
    title = text.title_of(F.col("t"), F.lit("@c post"))
    assert one(spark, title, t="\n *** 12\n  Real title \nmore") == "Real title"
    assert one(spark, title, t="123\n!!!") == "123"
    assert one(spark, title, t=None) == "@c post"
    assert len(one(spark, title, t="x" * 300)) == 140
    assert one(spark, text.cut_title(F.col("t"), 5), t="abcdefg") == "abcde…"


def test_content_hash_ignores_links_case_and_space(spark):
    of = lambda t: one(spark, text.content_hash(F.col("t")), t=t)
    assert of("Hello  World https://a.org/x") == of("hello world")
    assert of("https://a.org") == "" == of(None)


def test_base64url(spark):
    assert one(spark, text.decode_base64url(F.col("t")), t="w4TDlj8-") == "ÄÖ?>"
    assert one(spark, text.decode_base64url(F.col("t")), t="YQ") == "a"


def test_needs_translation(spark):
    assert one(spark, text.needs_translation(F.col("t")), t="Привет world") is True
    assert one(spark, text.needs_translation(F.col("t")), t="12 !") is False


def test_url_masks_come_back(spark):
    given = "see https://a.org/1 and https://b.org/2 " + " ".join(f"https://c.org/{i}" for i in range(12))
    df = spark.createDataFrame([(given,)], "t string").select("t", text.mask_urls("t").alias("m"))
    row = df.select("t", "m.masked", text.unmask_urls(F.col("m.masked"), F.col("m.urls")).alias("back")).first()
    assert "https" not in row["masked"] and row["back"] == given


def test_preferred_body(spark):
    pick = lambda a, b: one(spark, text.preferred_body(F.col("a"), F.col("b")), a=a, b=b)
    assert pick("View in browser", "a" * 100) == "a" * 100
    assert pick("same", "same") == "same"
    assert pick("long plain text. " * 9, "short") == "long plain text. " * 9


def test_times(spark):
    at = lambda t: one(spark, F.unix_timestamp(times.parse_time(F.col("t"), NOW)), t=t)
    assert at("2024-01-30T00:00:00Z") == NOW - 86400
    assert at("Tue, 30 Jan 2024 00:00:00 +0000") == NOW - 86400
    assert at("2024-01-30T05:30:00") == NOW - 86400 + 19800  # as UTC: nearer to now, and not later
    assert at("2024-01-31T05:00:00") == NOW - 1800  # as local time, since UTC would be to come
    assert at("never") is None
    assert one(spark, times.age_days(F.lit(NOW + 1), NOW)) == -1
    assert one(spark, times.age_days(F.lit(0), NOW)) is None
    assert one(spark, times.short_age_ts(F.col("t"), NOW), t="2mo") == NOW - 2 * 2592000
    assert one(spark, times.short_age_ts(F.col("t"), NOW), t="soon") == 0
    assert one(spark, times.duration_label(F.lit(3725.9))) == "62:05"
    gone = {0: "now", 1: "a second ago", 59: "59 seconds ago", 60: "a minute ago", 3600: "an hour ago", 7200: "2 hours ago", 86400: "a day ago", 31 * 86400: "a month ago",
            365 * 86400: "a year ago", 366 * 86400: "1 year, 1 day ago", 400 * 86400: "1 year, 1 month ago", 800 * 86400: "2 years ago", -7200: "2 hours from now"}
    df = spark.createDataFrame(list(gone.items()), "gone long, label string")
    assert df.where(times.relative_label(NOW - F.col("gone"), NOW) != F.col("label")).collect() == []
    assert one(spark, times.iso_from_ts(F.lit(NOW))) == "2024-01-31T05:30:00+05:30" and one(spark, times.iso_from_ts(F.lit(NOW), "America/New_York")).endswith("T19:00:00-05:00")


def test_mail_dates(spark):
    """Forms of dates that mails have, against the standard library's parser."""
    texts = [
        "Tue, 30 Jan 2024 10:00:00 GMT", "Tue, 30 Jan 2024 10:00:00 +0000 (UTC)", "30 Jan 2024 10:00 +0000", "3 Jan 2024 10:00:00 EST", "Wed, 03 Jan 2024 10:00:00 -0730", "Wed, 3 Jan 24 10:00:00 PDT",
        "Wed,  3 Jan 2024 10:00:00 +0530 (India Standard Time)", "Sun, 31 Dec 99 23:59:59 UT", "tue, 30 jan 2024 10:00:00 gmt", "Tue, 30 Jan 2024 10:00:00 -0000", "30 Jan 2024 10:00:00",
    ]
    for text in texts:
        wanted = parsedate_to_datetime(text)
        found = one(spark, F.unix_timestamp(times.parse_time(F.col("t"), NOW)), t=text)
        assert found == int((wanted if wanted.tzinfo else wanted.replace(tzinfo=timezone.utc)).timestamp()), text
    for text in ("2024-01-30", "2024-01-30 10:00", "2024-01-30T10:00:00.123456", "2024-01-30T10:00:00.5+05:30", "2024-01-30T10:00:00-0800", "2024-01-30T10:00:00+00:00"):
        wanted = datetime.fromisoformat(text)
        found = one(spark, F.unix_timestamp(times.parse_time(F.col("t"), NOW)), t=text)
        assert found == int((wanted if wanted.tzinfo else wanted.replace(tzinfo=timezone.utc)).timestamp()), text
    for text in ("", "2024", "32 Jan 2024 10:00:00 GMT", "30 Foo 2024 10:00:00 GMT", "2024-13-01", "10:00:00", "x" * 100_000):
        assert one(spark, times.parse_time(F.col("t"), NOW), t=text) is None, text


@pytest.mark.parametrize("part", ["<style>", "<script ", "<", "<br", "<a href='x'>", "<a ", "<a href=", "<div><a href=\"\">", " \n", "ℏ ", "</a", "<style></script>", "\t"])
def test_markup_is_read_in_few_passes(spark, part):
    page = part * (2_000_000 // len(part))
    df = spark.createDataFrame([(page,)], "h string")
    began = time.perf_counter()
    df.select(F.length(text.clean_html(F.col("h"))), F.length(text.normalize_lines(F.col("h"))), F.length(text.strip_urls(F.col("h")))).collect()
    links.links_of(page)
    assert time.perf_counter() - began < 15


def test_blanks_of_other_scripts_end_a_link(spark):
    told = "see https://a.org/x\u00a0now \u2003www.b.org\u2003and\u3000"
    assert one(spark, text.strip_urls(F.col("t")), t=told) == "see \u00a0now \u2003\u2003and"
    plain = hashlib.sha1("see now www.b.org and".encode()).hexdigest()
    assert one(spark, text.content_hash(F.col("t")), t=told) == plain
    for long in ("word " * 3000, "https://" + "x" * 5000 + " end", "y" * 3000, "a  \n" * 900 + "b", "http://u.org " * 300 + "tail", ("z" * 499 + " ") * 6):
        low = re.sub(r"\s+", " ", re.sub(r"https?://\S+", "", long.lower())).strip()[:500]
        assert one(spark, text.content_hash(F.col("t")), t=long) == (hashlib.sha1(low.encode()).hexdigest() if low else ""), long[:20]
    assert one(spark, text.first_line(F.col("t")), t="one\u2028two") == "one"
    assert one(spark, text.unescape_html(F.col("t")), t="&amp; &#" + "9" * 6000 + ";") == "& \ufffd"


def test_anchors_are_those_of_the_pattern():
    """Anchors by places against the pattern that says what an anchor is."""
    pattern = re.compile(r"""<a\s+[^>]*href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>""", re.I | re.S)
    rng = random.Random(6)
    parts = ["<a ", "<A\n", "href=", "HREF = ", '"', "'", "x", ">", "</a>", "</A>", "<b>", " ", "y.org"]
    for _ in range(60_000):
        page = "".join(rng.choices(parts, k=rng.randrange(18)))
        wanted = [(m.start(), m.end(), m[1], m[2]) for m in pattern.finditer(page)]
        assert list(links.Anchors(page)) == wanted, page


def test_links_in_context(spark):
    page = "<style>a{}</style><p>Before <a class=x href='https://a.org/1'>The <b>anchor</b></a> after</p><a href=''>no</a>"
    found = one(spark, links.links_in_context("h"), h=page)
    assert [(x["anchor"], x["href"], x["context"]) for x in found] == [("The anchor", "https://a.org/1", "Before  The anchor  after no")]


def test_resolve_follows_short_links_twice(spark):
    given = spark.createDataFrame([("https://bit.ly/a",), ("https://x.org",)], "url string")
    table = spark.createDataFrame([("https://bit.ly/a", "https://t.co/b"), ("https://t.co/b", "https://y.org"), ("https://x.org", "https://z.org")], "url string, target string")
    assert {r["url"]: r["resolved"] for r in links.resolve(given, table).collect()} == {"https://bit.ly/a": "https://y.org", "https://x.org": "https://x.org"}
