"""The feed's filter language: clauses parsed on the driver, compiled to one Column predicate.

``word``, ``"a phrase"``, ``sender:x``, ``source:x``, ``site:x`` (or host, domain), ``is:read|unread|skipped``,
``age:>7d``; a leading ``-`` negates; any other ``op:x`` looks for x in title and summary.
"""

from __future__ import annotations

import operator
import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days of each unit.
DAYS = {"d": 1, "day": 1, "days": 1, "w": 7, "wk": 7, "weeks": 7, "mo": 30, "month": 30, "months": 30, "y": 365, "yr": 365, "year": 365, "years": 365}
COMPARISONS: dict[str, Callable[[Column, int], Column]] = {
    "<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt, "=": operator.eq,
}
LETTERS = frozenset(string.ascii_letters)


@dataclass(frozen=True)
class Clause:
    op: str
    value: str
    negated: bool = False


def _operator_end(query: str, at: int) -> int:
    """Where an operator that begins at a place ends, behind its colon; the place itself if none does."""
    end = at
    while end < len(query) and query[end] in LETTERS:
        end += 1
    return end + 1 if end > at and query[end : end + 1] == ":" else at


def _value_end(query: str, at: int) -> int:
    """Where a value that begins at a place ends: at its second quote if something is quoted, else at a blank."""
    close = query.find('"', at + 1) if query[at : at + 1] == '"' else -1
    if close > at + 1:
        return close + 1
    while at < len(query) and not query[at].isspace():
        at += 1
    return at


def _clause(query: str, at: int) -> tuple[Clause | None, int]:
    """The clause at a place, null if it has no value, and where it ends.

    A sign or an operator that no value follows is a value itself.
    """
    sign = at + (query[at] == "-")
    name = _operator_end(query, sign)
    for negated, begin, value in ((sign > at, sign, name), (sign > at, sign, sign), (False, at, _operator_end(query, at)), (False, at, at)):
        end = _value_end(query, value)
        if end > value:
            break
    quoted = query[value] == '"' and end - value > 2 and query[end - 1] == '"' and query.find('"', value + 1) == end - 1
    told = query[value + 1 : end - 1] if quoted else query[value:end].strip('"')
    return (Clause(query[begin:value].rstrip(":").lower(), told, negated) if told else None), end


def parse(query: str) -> list[Clause]:
    """The clauses of a query; all must hold."""
    found, at, query = [], 0, query or ""
    while at < len(query):
        if query[at].isspace():
            at += 1
            continue
        clause, at = _clause(query, at)
        if clause:
            found.append(clause)
    return found


def parse_age(text: str) -> tuple[str, int] | None:
    """(comparison, days) of an age; None if it isn't one."""
    text = text.strip()
    sign = next((x for x in COMPARISONS if x != "=" and text.startswith(x)), "")
    rest = text.removeprefix(sign).lstrip()
    unit = rest.lstrip("0123456789")
    number, unit = rest.removesuffix(unit), unit.lstrip().lower()
    return (sign or "=", int(number) * DAYS[unit]) if number and len(number) < 10 and unit in DAYS else None


def wants_skipped(clauses: list[Clause]) -> bool:
    return any(c.op == "is" and c.value.lower() == "skipped" for c in clauses)


def _word(value: str) -> Column:
    """Title or summary has the value between signs that are no ASCII letters or digits."""
    # (?s) and a literal block: any value is plain text for the pattern.
    pattern = r"(?s)(?<![a-z0-9])\Q" + value.replace(r"\E", r"\E\\E\Q") + r"\E(?![a-z0-9])"
    return _title().rlike(pattern) | _summary().rlike(pattern)


def _age(value: str) -> Column:
    age = parse_age(value)
    return COMPARISONS[age[0]](F.col("age_days"), age[1]) if age else F.lit(False)


def _flag(value: str) -> Column:
    return {"read": F.col("is_read"), "unread": ~F.col("is_read"), "skipped": F.col("skipped")}.get(value, F.lit(False))


def _title() -> Column:
    return F.lower(F.coalesce("title", F.lit("")))


def _summary() -> Column:
    return F.lower(F.coalesce("summary", F.lit("")))


def _anywhere(value: str) -> Column:
    return _title().contains(value) | _summary().contains(value)


def _site(value: str) -> Column:
    return F.lower("primary_url_host").contains(value)


#: What each operator asks of a row, given the value in lower case; operators that aren't listed ask ``_anywhere``.
CONDITIONS: dict[str, Callable[[str], Column]] = {
    "": _word,
    "sender": lambda value: F.exists("all_senders", lambda s: F.lower(s).contains(value)),
    "source": lambda value: F.lower("source_type") == value,
    "is": _flag, "age": _age, "site": _site, "host": _site, "domain": _site,
}


def compile_clauses(clauses: list[Clause]) -> Column:
    """One predicate over the feed's columns; unknown is false before a negation."""
    out = F.lit(True)
    for clause in clauses:
        holds = F.coalesce(CONDITIONS.get(clause.op, _anywhere)(clause.value.lower()), F.lit(False))
        out = out & (~holds if clause.negated else holds)
    return out
