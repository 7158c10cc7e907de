"""A stored index of words for the feed's word and phrase clauses.

For each word (run of ASCII letters and digits, in lower case) of a title or summary the index has the places where it stands.
A value that a clause looks for can only stand where its words stand one after another, so the rows to which that applies
are the only ones whose text is read; the clause's own pattern decides on them. A value without such a word (other
scripts, signs) is looked for in all rows.

Postings lie in ``BUCKETS`` folders by word, and a clause reads those of its words. Rows are added in batches; of a row
that was added again older postings stay, which is harmless, as patterns decide on the row as it is.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.plans.query_language import Clause, compile_clauses
from storyloom.streaming.store import BatchStore

BUCKETS = 64
POSTINGS = "word string, id long, field int, places array<int>, bucket int"


def words_of(value: str) -> list[str]:
    return re.findall("[a-z0-9]+", value.lower())


def _places(value: Column) -> Column:
    """The words of a value in lower case, each once with its places: sorted with them and cut where the next word begins, so no row leaves its task."""
    words = F.transform(F.split(value, "[^a-z0-9]+"), lambda x, i: F.struct(x.alias("word"), i.alias("place")))
    ordered = F.sort_array(F.filter(words, lambda x: x["word"] != ""))

    def cut(held: Column) -> Column:
        n = F.size(held)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == 1) | (F.get(held, i - 1)["word"] != F.get(held, i - 2)["word"]))
        ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), F.array(n + 1))
        found = F.zip_with(starts, ends, lambda i, j: F.struct(F.get(held, i - 1)["word"].alias("word"), F.slice(held, i, F.greatest(j - i, F.lit(0)))["place"].alias("places")))
        return F.filter(found, lambda x: x["word"].isNotNull())

    # A lambda binds the sorted words, which are named many times.
    return F.flatten(F.transform(F.array(ordered), cut))


class SearchIndex(BatchStore):
    """Postings of rows (id, title, summary) in a folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, {"postings": POSTINGS}, {"postings": "bucket"})

    def add(self, rows: DataFrame, number: int) -> bool:
        """Take a batch of rows in; False if it was taken before. Rows without an id can't be found by it and must not be searched with it."""
        fields = F.array(*[F.struct(F.lit(k).alias("field"), _places(F.lower(F.coalesce(name, F.lit("")))).alias("words")) for k, name in enumerate(("title", "summary"))])
        each = rows.where(F.col("id").isNotNull()).select("id", F.explode(fields).alias("f")).select("id", "f.field", F.explode("f.words").alias("w"))
        found = each.select("w.word", "id", "field", "w.places")
        return self.commit(number, {"postings": found.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))})

    def candidates(self, value: str) -> DataFrame | None:
        """(id) of the rows in one field of which the value's words stand one after another; None if it has no word."""
        words = words_of(value)
        if not words:
            return None
        postings = self.read("postings")
        shifted = lambda k: F.transform("places", lambda p: p - k).alias(f"p{k}")
        lists = []
        for k, word in enumerate(words):
            there = postings.where((F.col("bucket") == F.pmod(F.xxhash64(F.lit(word)), F.lit(BUCKETS)).cast("int")) & (F.col("word") == word))
            lists.append(there.select("id", "field", shifted(k)))
        # Versions of a row may meet each other here; that only makes more candidates.
        both = reduce(lambda a, b: a.join(b, ["id", "field"]), lists)
        starts = reduce(F.array_intersect, [F.col(f"p{k}") for k in range(len(words))])
        return both.where(F.size(starts) > 0).select("id").distinct()

    def matching(self, rows: DataFrame, clauses: list[Clause]) -> DataFrame:
        """The rows for which all clauses hold, as ``compile_clauses`` has it."""
        rest = []
        for clause in clauses:
            ids = self.candidates(clause.value) if clause.op == "" else None
            if ids is None:
                rest.append(clause)
            elif clause.negated:
                hit = rows.join(ids, "id", "left_semi").where(compile_clauses([Clause("", clause.value)])).select("id").distinct()
                rows = rows.join(hit, "id", "left_anti")
            else:
                rows = rows.join(ids, "id", "left_semi")
                rest.append(clause)
        return rows.where(compile_clauses(rest))
