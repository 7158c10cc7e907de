"""Runs of ingestion as a stream: items find or make their stories, batch by batch, each batch in one transaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from storyloom.operators import vector_index
from storyloom.operators.clusters import THRESHOLD, persist_stories
from storyloom.streaming.ingest import run_batches
from storyloom.streaming.store import BatchStore, last_of_key

STORY = "story_id long, title string, summary string, mention_count long, new_info_count long, is_read boolean, first_seen long, last_updated long"
TABLES = {
    "stories": STORY, "vectors": "id long, vector array<double>",
    "mentions": "id long, story_id long, title string, summary string, sender string, gmail_url string, date string, source_type string, created_at long, added_new_info boolean",
    "timeline": "story_id long, id long, date string, what_changed string, trigger_sender string", "outcomes": "id long, outcome string",
    **vector_index.TABLES,
}


class StoryStore(BatchStore):
    """Stories (the last state of each), their vectors with an index, mentions, timeline and the outcomes of items."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, TABLES)
        self.index = vector_index.StoredIndex(self)

    def stories(self, upto: int | None = None) -> DataFrame:
        return self.latest("stories", "story_id", upto)

    def begin(self, stories: DataFrame, vectors: DataFrame) -> None:
        """Stories that are there before the first batch."""
        self.commit(-1, {"stories": stories, "vectors": vectors, **self.index.added(vectors)})

    def ingest(self, items: DataFrame, number: int, embed: Callable[[Column], Column], check: Callable, now: int, threshold: float = THRESHOLD, **how) -> bool:
        """One batch of items in one transaction; False if it was committed before."""
        if number in self.batches():
            return False
        run = persist_stories(items, self.stories(), self.read("vectors").drop("batch"), embed, check, now, threshold, self.index.open(), **how)
        return self.commit(number, {"stories": run["changed"], "vectors": run["added"], **self.index.added(run["added"]), **{name: run[name] for name in ("mentions", "timeline", "outcomes")}})

    def shorten(self, number: int) -> None:
        """Compact all batches up to one: the last state of each story, all rows of the other tables."""
        self.compact(number, {"stories": lambda rows: last_of_key(rows, "story_id"), **{name: lambda rows: rows for name in TABLES if name != "stories"}})


def persist_stream(
    items: DataFrame, store: StoryStore, checkpoint: str, embed: Callable[[Column], Column], check: Callable, now: Callable[[int], int], threshold: float = THRESHOLD, **how,
) -> None:
    """Ingest what is new in a stream of items, whose ids ascend from batch to batch.

    A batch that was lost between two of its tables is run again from the state before it; what it had written is
    never seen. ``now`` gives the time of a batch.
    """
    run_batches(items, lambda batch, number: store.ingest(batch, number, embed, check, now(number), threshold, **how), checkpoint)
