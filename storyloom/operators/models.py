"""Model calls behind a provider; the offline one is deterministic and needs no network.

A provider is a small object that is made once per task. Calls are scalar Arrow functions over slices of batches, so a
plan filters first and calls last.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.slices import by_slices
from storyloom.functions.text import META_TITLES, mask_urls, needs_translation, strip, unmask_urls

# Marks of a rate limit in an error's text.
RATE_LIMIT_MARKS = ("429", "rate limit", "quota", "resource exhausted", "too many requests")


def is_rate_limit(error: Exception) -> bool:
    status = getattr(error, "status_code", None) or getattr(error, "code", None)
    return status == 429 or any(mark in str(error).lower() for mark in RATE_LIMIT_MARKS)


@dataclass
class Offline:
    """Answers made from the words of the question alone."""

    dimensions: int = 64
    news_share: float = 0.5

    def embed(self, text: str) -> list[float]:
        """Hashed bag of words of unit length; where the signs of all words cancel each other, they count without sign."""
        vector, count = np.zeros(self.dimensions), np.zeros(self.dimensions)
        for word in re.findall(r"\w+", text.lower()):
            digest = hashlib.md5(word.encode()).digest()
            place = int.from_bytes(digest[:4], "little") % self.dimensions
            vector[place] += 1 if digest[4] & 1 else -1
            count[place] += 1
        vector = vector if vector.any() else count
        length = np.linalg.norm(vector)
        return (vector / length if length else vector).astype(np.float32).tolist()

    def extract(self, text: str) -> str:
        """A story for each paragraph: its first line is the title, the rest the summary; as JSON."""
        stories = []
        for part in re.split(r"\n\s*\n", text.strip()):
            title, _, rest = part.strip().partition("\n")
            if title:
                stories.append({"title": title.strip(), "summary": (rest or title).strip()})
        kind = "single_article" if len(stories) <= 1 else "curated_digest"
        return json.dumps({"content_type": kind, "stories": stories})

    def evolve(self, told: str, title: str, summary: str) -> tuple[bool, str, str]:
        """News if at least half of a mention's words are new to the story."""
        words = lambda x: set(re.findall(r"\w+", x.lower()))
        new = words(f"{title} {summary}") - words(told)
        news = len(new) >= self.news_share * max(len(words(f"{title} {summary}")), 1)
        return news, title if news else "", f"{told} {title}".strip() if news else ""

    def translate(self, text: str) -> str | None:
        return text or None

    def healthy(self) -> bool:
        return True


@dataclass
class Rotating:
    """A provider that goes on to the next model on a rate limit; other errors pass through."""

    models: list[str]
    call: Callable[[str, str], str]
    used: list[str] = field(default_factory=list)

    def chat(self, prompt: str, model: str | None = None) -> str:
        if model:
            return self.call(model, prompt)
        for name in self.models:
            try:
                self.used.append(name)
                return self.call(name, prompt)
            except Exception as error:  # noqa: BLE001
                if not is_rate_limit(error):
                    raise
        raise RuntimeError("all models are at their rate limit")


PROVIDERS: dict[str, Callable[[], object]] = {"offline": Offline}


def provider(name: str = "offline") -> object:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider: {name}")
    return PROVIDERS[name]()


def _calls(method: str, returns: str, name: str) -> Callable[[Column], Column]:
    kind = {"string": pa.string(), "array<float>": pa.list_(pa.float32())}[returns]

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = getattr(provider(name), method)
        return by_slices(lambda texts: pa.array([None if x is None else call(x) for x in texts.to_pylist()], kind))(columns)

    return F.arrow_udf(run, returns)


def embed(text: Column, name: str = "offline") -> Column:
    """The text's vector; the input of a story is its title and summary joined by '. '."""
    return _calls("embed", "array<float>", name)(text)


def translate(text: Column, name: str = "offline") -> Column:
    """The translation, null where it is to be tried again. Links are masked for the model and put back."""
    masked = mask_urls(text)
    told = strip(_calls("translate", "string", name)(masked["masked"]))
    return F.nullif(unmask_urls(told, masked["urls"]), F.lit(""))


def in_english(text: Column, name: str = "offline") -> Column:
    """The text, translated where it needs to be; null where the translation is to be tried again."""
    return F.when(needs_translation(text), translate(F.when(needs_translation(text), text), name)).otherwise(text)


def chat(prompts: Column, ask: Callable[[], Callable[[str], str]]) -> Column:
    """Answers to prompts; ``ask`` makes the function that answers, once per task (a ``Rotating`` provider's chat, say)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = ask()
        for texts in batches:
            yield texts.map(lambda x: None if x is None else answer(x))

    return F.pandas_udf(run, "string")(prompts)


def split_messages(messages: Column) -> Column:
    """(system, contents) of an array of (role, text): the system texts joined, and the others as (role, text).

    System texts without more than white space don't count; there is no system text where none is left. The
    assistant's role is model, all others' user. Without any content there is one empty text of the user.
    """
    role = lambda m: F.lower(F.btrim(F.coalesce(F.nullif(m["role"], F.lit("")), F.lit("user"))))
    text = lambda m: F.coalesce(m["text"], F.lit(""))
    system = F.filter(F.transform(F.filter(messages, lambda m: role(m) == "system"), lambda m: strip(text(m))), lambda x: x != "")
    named = lambda m: F.struct(F.when(role(m) == "assistant", F.lit("model")).otherwise(F.lit("user")).alias("role"), text(m).alias("text"))
    contents = F.transform(F.filter(messages, lambda m: role(m) != "system"), named)
    nothing = F.array(F.struct(F.lit("user").alias("role"), F.lit("").alias("text")))
    return F.struct(
        F.nullif(F.array_join(system, "\n\n"), F.lit("")).alias("system"), F.when(F.size(contents) > 0, contents).otherwise(nothing).alias("contents")
    )


def extract_stories(mails: DataFrame, name: str = "offline") -> DataFrame:
    """(id, pos, content_type, title, summary, failed): stories of mails (id, body), meta titles and empty ones left out.

    The provider is asked whether it answers before any mail is handed to it. A mail whose answer is no JSON of the wanted shape gives one row with ``failed`` and is to be tried again.
    """
    if not provider(name).healthy():
        raise RuntimeError(f"provider {name} doesn't answer")
    schema = "content_type string, stories array<struct<title: string, summary: string>>"
    answered = mails.select("id", _calls("extract", "string", name)(F.col("body")).alias("answer"))
    parsed = answered.select("id", F.from_json("answer", schema).alias("a")).withColumn("failed", F.col("a.stories").isNull())
    rows = parsed.select("id", "failed", "a.content_type", F.posexplode_outer("a.stories").alias("pos", "s"))
    rows = rows.select("id", "pos", "content_type", F.btrim("s.title").alias("title"), F.btrim("s.summary").alias("summary"), "failed")
    told = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("summary", F.lit("")) != "") & ~F.lower("title").isin(*META_TITLES)
    return rows.where(F.col("failed") | told)
