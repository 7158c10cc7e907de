"""Leader clusters of stories in order of arrival, the fold that lets a story evolve, and both as a run of ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators.graph import cut, first_independent_set
from storyloom.operators.similarity import similar_pairs
from storyloom.operators.vector_index import SLACK, VectorIndex

THRESHOLD = 0.80
CHECK_AFTER = 2
#: Rows of the first block of leader clustering, and how much longer all blocks are with each further one.
FIRST, GROWTH = 8192, 8


def leader_clusters(rows: DataFrame, threshold: float = THRESHOLD, known: DataFrame | VectorIndex | None = None, **how) -> DataFrame:
    """(id, leader, similarity) of rows (id, vector) taken in order of id; those without a vector are left out.

    A row joins the most similar leader before it that is alike enough, else it leads; leaders keep their
    vector. ``known`` are leaders (id, vector) of earlier runs, or their index, before all rows. Ties go to the smallest id.

    Who leads depends on earlier leaders only. So rows go by blocks of ids, each ``GROWTH`` times as long as all before it: rows of
    a block near an earlier leader fall out, and the leaders among the rest are the independent set by order of the graph of alike
    rows. That graph is of rows no leader has taken so far, so its pairs hardly grow with the table. The others then pick
    among all leaders, and only the best one of each comes out.
    """
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select(F.col("id").cast("long").alias("id"), "vector")
    near, leading = None, rows.limit(0)
    if known is not None:
        index = known if isinstance(known, VectorIndex) else VectorIndex.build(known)
        near = cut(index.best_within(rows, threshold).withColumnRenamed("nearest_id", "leader"))
    for number, block in enumerate(_blocks(rows)):
        left = block if near is None else block.join(near.select("id"), "id", "left_anti")
        if number:
            left = left.join(VectorIndex.build(leading).best_within(left, threshold).select("id"), "id", "left_anti")
        left = cut(left)
        first = first_independent_set(left.select(F.col("id").alias("node")), similar_pairs(left, threshold, **how))
        leading = cut(leading.unionByName(left.join(first.select(F.col("node").alias("id")), "id", "left_semi")))
    leaders = leading.select("id").distinct()
    # A row that a pair has ruled out needs a leader, so what rounding may take off is let in; the best one stays.
    found = VectorIndex.build(leading).best_within(rows.join(leaders, "id", "left_anti"), threshold - SLACK, earlier=True).withColumnRenamed("nearest_id", "leader")
    if near is not None:
        best = F.max(F.struct("similarity", (-F.col("leader")).alias("minus"))).alias("t")
        found = found.unionByName(near).groupBy("id").agg(best).select("id", (-F.col("t.minus")).alias("leader"), F.col("t.similarity").alias("similarity"))
    return leaders.select("id", F.col("id").alias("leader"), F.lit(1.0).alias("similarity")).unionByName(found)


def _blocks(rows: DataFrame) -> list[DataFrame]:
    """The rows in ranges of ids, of about ``FIRST`` rows and then ``GROWTH - 1`` times as many as before."""
    n, at, parts = rows.count(), FIRST, []
    while at < n:
        parts.append(at / n)
        at *= GROWTH
    ends = sorted(set(rows.agg(F.percentile_approx("id", parts, F.lit(10_000))).first()[0])) if parts else []
    between = lambda low, high: (F.lit(True) if low is None else F.col("id") > low) & (F.lit(True) if high is None else F.col("id") <= high)
    return [rows.where(between(low, high)) for low, high in zip([None, *ends], [*ends, None], strict=True)]


def evolve(mentions: DataFrame, check: Callable[[str, str, str], tuple[bool, str, str]], stories: DataFrame | None = None) -> DataFrame:
    """(id, story_id, outcome, what_changed, story_summary) of mentions (id, story_id, title, summary) in order of id.

    The first mention makes the story, the next ones are merged; from the third on ``check(story's summary,
    title, summary)`` says (news, what changed, new summary). News with a change evolves the story, whose
    summary becomes the new one or has the change put after it. ``stories`` (story_id, summary, mention_count) are
    those of earlier runs, which go on. ``story_summary`` is given where it is new, so a row is no copy of what the
    story has become; the last one given is the story's. The fold runs along sorted partitions and holds one
    story's summary at a time, however many mentions it has.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        story, told, n = None, "", 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["story_id"] != story or story is None:
                    story, told, n = row["story_id"], row["summary"] or "", row["told_before"] or 0
                if row["told_before"] is not None:
                    continue
                outcome, change = ("new", None) if n == 0 else ("merged", None)
                if n >= CHECK_AFTER:
                    news, changed, updated = check(told, row["title"] or "", row["summary"] or "")
                    if news and changed:
                        outcome, change = "evolved", changed
                        told = (updated or f"{told} {changed}").strip()
                n += 1
                out.append((row["id"], story, outcome, change, told if outcome != "merged" else None))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                names = ["id", "story_id", "outcome", "what_changed", "story_summary"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = mentions.select(F.col("id").cast("long"), F.col("story_id").cast("long"), "title", "summary", F.lit(None).cast("long").alias("told_before"))
    if stories is not None:
        asked = mentions.select("story_id").distinct()
        before = stories.join(asked, "story_id", "left_semi").select(
            F.lit(None).cast("long").alias("id"), F.col("story_id").cast("long").alias("story_id"), F.lit(None).cast("string").alias("title"), "summary",
            F.col("mention_count").cast("long").alias("told_before"),
        )
        rows = before.unionByName(rows)
    ordered = rows.repartition("story_id").sortWithinPartitions("story_id", F.asc_nulls_first("id"))
    return ordered.mapInArrow(fold, "id long, story_id long, outcome string, what_changed string, story_summary string")


def persist_stories(
    items: DataFrame, stories: DataFrame, vectors: DataFrame, embed: Callable[[Column], Column], check: Callable[[str, str, str], tuple[bool, str, str]],
    now: int, threshold: float = THRESHOLD, index: VectorIndex | None = None, **how,
) -> dict[str, DataFrame]:
    """A run of ingestion: items find or make their stories. Gives the state after it and what it adds.

    ``items`` have id (ascending, above all stories' ids), title, summary, sender, gmail_url, date, source_type;
    ``stories`` story_id, title, summary, mention_count, new_info_count, is_read, first_seen, last_updated; ``vectors``
    id, vector of the stories, ``index`` an index of them if there is one. The result has ``stories`` and ``vectors`` after the run, the ``mentions`` and ``timeline``
    rows it adds, and ``outcomes`` (id, outcome): new, merged, evolved, or failed where no vector could be made.
    ``changed`` are the stories that the run made or changed and ``added`` the vectors it made, for a log of states.
    A story that evolves is unread again. Run by run in batches of any size, or as a stream (``streaming.stories``),
    the result is the same as item by item.
    """
    told = cut(items.withColumn("vector", embed(F.concat_ws(". ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))))
    good = told.where(F.col("vector").isNotNull())
    placed = cut(leader_clusters(good.select("id", "vector"), threshold, index or vectors, **how).select("id", F.col("leader").alias("story_id")))
    steps = cut(evolve(good.drop("vector").join(placed, "id").select("id", "story_id", "title", "summary"), check, stories))
    of_item = good.drop("vector").join(steps, "id")
    mentions = of_item.select(
        "id", "story_id", "title", "summary", "sender", "gmail_url", "date", "source_type", F.lit(now).alias("created_at"),
        (F.col("outcome") == "evolved").alias("added_new_info"),
    )
    timeline = of_item.where("outcome = 'evolved'").select("story_id", "id", "date", "what_changed", F.col("sender").alias("trigger_sender"))
    change = steps.groupBy("story_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("outcome") == "evolved").alias("_news"),
        F.max(F.when(F.col("story_summary").isNotNull(), F.struct("id", "story_summary")))["story_summary"].alias("_summary"),
    )
    change = cut(change)
    kept = stories.join(change, "story_id", "left").withColumns(
        {
            "summary": F.coalesce("_summary", "summary"), "mention_count": F.col("mention_count") + F.coalesce("_n", F.lit(0)),
            "new_info_count": F.col("new_info_count") + F.coalesce("_news", F.lit(0)), "is_read": F.col("is_read") & (F.coalesce("_news", F.lit(0)) == 0),
            "last_updated": F.when(F.col("_n").isNotNull(), F.lit(now)).otherwise(F.col("last_updated")),
        }
    )
    made = of_item.where("outcome = 'new'").select("story_id", "title").join(change, "story_id").select(
        "story_id", "title", F.col("_summary").alias("summary"), F.col("_n").alias("mention_count"), F.col("_news").alias("new_info_count"),
        F.lit(False).alias("is_read"), F.lit(now).alias("first_seen"), F.lit(now).alias("last_updated"),
    )
    leading = steps.where("outcome = 'new'").select("id")
    outcomes = steps.select("id", "outcome").unionByName(told.where(F.col("vector").isNull()).select("id", F.lit("failed").alias("outcome")))
    made, added = made.select(*stories.columns), good.join(leading, "id", "left_semi").select("id", "vector")
    return {
        "stories": kept.select(*stories.columns).unionByName(made), "changed": kept.where("_n IS NOT NULL").select(*stories.columns).unionByName(made),
        "vectors": vectors.unionByName(added), "added": added, "mentions": mentions, "timeline": timeline, "outcomes": outcomes,
    }
