"""URL functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of URLs that never lead to a story.
BAD_URL_PARTS = (
    "unsubscribe", "list-manage", "manage-subscriptions", "manage-preferences", "manage_subscriptions", "update-profile",
    "update_profile", "forward-this", "forward-to", "view-in-browser", "view_in_browser", "preferences", "archive/",
    "/profile/", "sendgrid.net", "mailchimp", "mailchi.mp", "mail.google.com", "substackcdn", "list.robinhood",
)
# How hosts that wrap links begin, and hosts that shorten them.
WRAPPER_PREFIXES = ("click.", "link.", "links.", "email.", "e.", "track.", "tracking.", "r.", "t.", "c.", "go.", "mail.", "ml.")
SHORTENERS = ("t.co", "bit.ly", "lnkd.in", "lnk.in", "ow.ly", "tinyurl.com", "tr.ee", "buff.ly", "is.gd", "shorturl.at", "rebrand.ly")
MESSENGER_HOSTS = ("t.me", "telegram.me", "telegram.dog")
SOCIAL_HOSTS = ("x.com", "twitter.com")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def netloc(url: Column) -> Column:
    """What stands between the scheme and the path, lower case; empty where there is no scheme."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def host_of(url: Column) -> Column:
    """The netloc without one leading ``www.``; port and user stay."""
    return F.regexp_replace(netloc(url), r"^www\.", "")


def is_wrapper_host(host: Column) -> Column:
    return any_of([host.startswith(prefix) for prefix in WRAPPER_PREFIXES])


def is_shortener(host: Column) -> Column:
    return host.isin(*SHORTENERS)


def is_bad_url(url: Column, sender_host: Column | None = None) -> Column:
    """Not http(s), a part that is never a story, or the sender's own host or a host below it."""
    low = F.lower(F.coalesce(url, F.lit("")))
    bad = ~low.rlike("^https?://") | any_of([low.contains(part) for part in BAD_URL_PARTS])
    if sender_host is not None:
        host, own = host_of(low), F.coalesce(sender_host, F.lit(""))
        bad = bad | ((own != "") & (host != "") & ((host == own) | F.endswith(host, F.concat(F.lit("."), own))))
    return bad


def clean_post_link(href: Column) -> Column:
    """A link of a channel post, null if it stays inside the messenger."""
    inside = (href == "") | href.startswith("?q=") | href.startswith("/") | netloc(href).isin(*MESSENGER_HOSTS)
    return F.when(~F.coalesce(inside, F.lit(True)), href)


def is_sponsored(links: Column) -> Column:
    return F.exists(links, lambda x: x.rlike(r"(?i)([?&]|&amp;)erid="))


def external_hosts(links: Column) -> Column:
    """Distinct hosts of some links, without the social networks' own."""
    hosts = F.transform(links, host_of)
    return F.array_distinct(F.filter(hosts, lambda h: (h != "") & ~h.isin(*SOCIAL_HOSTS)))


def is_roundup(links: Column) -> Column:
    return F.size(external_hosts(links)) >= 3


def links_from_json(raw: Column) -> Column:
    """(url, host) of the strings of a JSON list that have a host; bad JSON gives an empty list."""
    urls = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(urls, lambda u: F.struct(u.alias("url"), host_of(u).alias("host"))), lambda x: x["host"] != "")
