"""Date and time functions as Column expressions; ``now`` is always given, as epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of the units of short ages.
AGE_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "mo": 2592000, "y": 31536000, "yr": 31536000}


# Hours from UTC of the zone names that mail dates may have.
ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Year, month, day, hour, minute, second, zone.
ISO = r"^\s*(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d{0,3})?)?\s*(Z|[+\-]\d{2}(?::?\d{2})?)?\s*$"
#: Day, month, year, hour, minute, second, zone; a weekday before and a remark behind may be there.
MAIL = r"(?i)^\s*(?:[a-z]{3,9}\.?,?\s+)?(\d{1,2})[\s\-]+([a-z]{3})[a-z]*[.,]?[\s\-]+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+\-]\d{4}|[a-z]{1,5})?\s*(?:\([^)]*\)\s*)?$"


def _offset(zone: Column) -> Column:
    """Seconds from UTC of a zone, by number or name; null for none, for unknown names and for -0000, which says nothing."""
    number = F.regexp_replace(zone, ":", "")
    size = F.substring(number, 2, 2).try_cast("long") * 3600 + F.coalesce(F.substring(number, 4, 2).try_cast("long"), F.lit(0)) * 60
    by_number = F.when(number.startswith("-"), F.nullif(-size, F.lit(0))).when(number.startswith("+"), size)
    hours = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    return F.coalesce(by_number, F.try_element_at(hours, F.upper(zone)).cast("long") * 3600)


def parse_time(text: Column, now: int, zone: str = "Asia/Kolkata") -> Column:
    """A timestamp from ISO or RFC-2822 text, null if it is neither.

    Mail dates may lack the weekday, seconds and zone, have a year of two digits, a zone by name, and a remark
    behind. Text without a zone is taken as UTC or as local time of ``zone``: whichever of those no later than
    five minutes from ``now`` is nearer to it, or the nearer one if both are later.
    """
    # Year, month (a number or a name), day, hour, minute, second, zone; bound to names step by step, so that nothing
    # is matched or computed twice.
    cut = lambda pattern, order: F.split(F.regexp_replace(text, pattern, "|".join(f"${k}" for k in order)), r"\|")
    parts = F.when(text.rlike(ISO), cut(ISO, (1, 2, 3, 4, 5, 6, 7))).when(text.rlike(MAIL), cut(MAIL, (3, 2, 1, 4, 5, 6, 7)))
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    return bound(bound(parts, _clock), lambda c: _placed(c, now, zone))


def _clock(p: Column) -> Column:
    """(at, offset): the clock time as if of UTC, and the seconds that its zone is off, null without a zone."""
    number = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("0")).try_cast("int")
    name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(p[1])).cast("int")
    year, month = number(p[0]), F.coalesce(F.nullif(name, F.lit(0)), number(p[1]))
    year = F.when(F.length(p[0]) > 2, year).when(year > 68, year + 1900).otherwise(year + 2000)
    second = F.coalesce(F.nullif(p[5], F.lit("")), F.lit("0")).try_cast("decimal(8,6)")
    at = F.try_make_timestamp(year, month, number(p[2]), number(p[3]), number(p[4]), second, F.lit("UTC"))
    # An ISO offset of zero is UTC; -0000 in a mail is no zone.
    zero = F.when((name == 0) & (p[6] != ""), F.lit(0).cast("long"))
    return F.struct(at.alias("at"), F.coalesce(_offset(p[6]), zero).alias("offset"))


def _placed(c: Column, now: int, zone: str) -> Column:
    """The timestamp of a clock time; without a zone, of the two that it may be."""
    at, local = c["at"], F.to_utc_timestamp(c["at"], zone)
    late = lambda t: (F.unix_timestamp(t) > now + 300).cast("int")
    far = lambda t: F.abs(F.unix_timestamp(t) - now)
    use_local = (late(local) < late(at)) | ((late(local) == late(at)) & (far(local) < far(at)))
    zoned = F.timestamp_micros(F.unix_micros(at) - c["offset"] * 1_000_000)
    return F.when(c["offset"].isNotNull(), zoned).when(use_local, local).otherwise(at)


def age_days(ts: Column, now: int) -> Column:
    """Whole days since ``ts``, rounded down also for times to come; null for 0 and null."""
    return F.floor((F.lit(now) - F.nullif(ts, F.lit(0))) / 86400)


def iso_from_ts(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    """Epoch seconds as ISO text of a zone with its offset; empty for 0 and null."""
    at = F.timestamp_seconds(F.nullif(ts, F.lit(0)))
    local = F.from_utc_timestamp(at, zone)
    minutes = (F.unix_timestamp(local) - F.unix_timestamp(at)) / 60
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")), F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes).cast("int") % 60)
    return F.coalesce(F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset), F.lit(""))


def relative_label(ts: Column, now: int) -> Column:
    """How long ago (or from now), in words: the largest unit, months beside the first year; empty for 0 and null."""
    gone = F.lit(now) - F.nullif(ts, F.lit(0))
    size = F.abs(gone)
    years, days = F.floor(size / (365 * 86400)), F.floor(size / 86400) % 365
    months = F.floor(days * 2 / 61)  # of 30.5 days
    told = F.lit(None).cast("string")

    def counted(n: Column, one: str, name: str, before: str = "") -> Column:
        return F.when(n == 1, F.lit(before + one)).otherwise(F.concat(F.lit(before), n.cast("long").cast("string"), F.lit(f" {name}s")))

    steps = [
        (size == 0, F.lit(None).cast("string")),
        (size < 60, counted(size, "a second", "second")),
        (size < 3600, counted(F.floor(size / 60), "a minute", "minute")),
        (size < 86400, counted(F.floor(size / 3600), "an hour", "hour")),
        ((years == 0) & (months == 0), counted(days, "a day", "day")),
        (years == 0, counted(months, "a month", "month")),
        ((years == 1) & (days == 0), F.lit("a year")),
        ((years == 1) & (months == 0), counted(days, "1 day", "day", "1 year, ")),
        (years == 1, counted(months, "1 month", "month", "1 year, ")),
        (years > 1, counted(years, "", "year")),
    ]
    for when, words in reversed(steps):
        told = F.when(when, words).otherwise(told)
    label = F.concat(told, F.when(gone < 0, F.lit(" from now")).otherwise(F.lit(" ago")))
    return F.when(gone.isNull(), F.lit("")).when(gone == 0, F.lit("now")).otherwise(label)


def short_age_ts(text: Column, now: int) -> Column:
    """Epoch seconds of ages such as 3d, 2mo or 1yr; 0 for other text."""
    low = F.lower(F.btrim(text))
    number, unit = (F.regexp_extract(low, r"^(\d+)(s|m|h|d|w|mo|y|yr)$", k) for k in (1, 2))
    size = F.lit(None).cast("long")
    for name, seconds in AGE_SECONDS.items():
        size = F.when(unit == name, F.lit(seconds)).otherwise(size)
    return F.coalesce(F.lit(now) - F.nullif(number, F.lit("")).try_cast("long") * size, F.lit(0)).cast("long")


def duration_label(seconds: Column) -> Column:
    """m:ss; minutes aren't wrapped to hours."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), F.pmod(whole, F.lit(60)))


def freshness(ts: Column, now: int) -> Column:
    """exp(-hours / 36), a fifth at least; very old if the time is unknown."""
    hours = F.coalesce(F.greatest((F.lit(now) - F.nullif(ts, F.lit(0))) / 3600.0, F.lit(0.0)), F.lit(9999.0))
    return F.greatest(F.lit(0.2), F.exp(-hours / 36.0))
