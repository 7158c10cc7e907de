"""Benchmark decontamination over a positional inverted index, DataFrame functions only.

1. ``query_windows``: every item becomes windows of ten consecutive words (a shorter item is one window).
2. ``term_counts``: how often the corpus holds each test term: one pass, summed map-side. A window with a term
   that the corpus lacks can't occur and goes.
3. ``questions``: a window is asked for by its two rarest terms and their offsets, an item (for proximity) by its
   two rarest terms.
4. ``position_lists``: the index, stored in the shared folder: for each of these terms and each document that
   holds it, the sorted list of its positions.
5. ``answers``: from the rarest term's lists on. For a window both lists, less their offsets, are intersected:
   what is left is where the window can start. For an item the two lists are merged: it is near where
   neighbours of different terms stand at most ``slop`` words apart.
6. ``phrase_matches``: the words of the few documents with starts left decide.

Terms are looked up in full lower case, which also folds letters beyond A-Z; the check of whole windows is on
words with only A-Z folded, so it decides.

Defined results: a null text or item has no words; an empty benchmark or corpus gives no match; repeated rows
of the corpus (same id, same text) each get the same row; items with one text are items of their own; of equally
rare terms the first in byte order is taken. A list is as long as its document at most, and a long document is
handled within its row; matches are summed as intervals per document. A term, phrase or document that a third of
all rows share is spread: small sides are broadcast after a check of their size, larger ones joined with a salt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import cut, id_and_text, without

WINDOW, SLOP = 10, 16
#: What separates words, and A-Z is no separator as folding comes later.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the benchmark's side that are sent to all tasks; above, joins shuffle with each row dealt to ``SALTS`` places.
BROADCAST_TERMS, SALTS = 500_000, 32
KEY = ("doc_id", "text_key")


def words(text: Column) -> Column:
    """Words of a text in their own case. The first and last may be empty; they stand for no word."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def _folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def query_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, phrase, terms): every window of every item; phrase is its words joined by a blank."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.filter(words(_folded(F.col(text_col))), lambda x: x != "").alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    each = items.where(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("at"))
    found = each.select("item_id", F.slice("w", F.col("at"), F.lit(window)).alias("terms")).distinct()
    return found.select("item_id", F.array_join("terms", " ").alias("phrase"), "terms")


def _join(rows: DataFrame, small: DataFrame, on: str, n: int) -> DataFrame:
    """``rows`` joined with the benchmark's side of ``n`` rows; a value that many rows have lands in many tasks."""
    if n <= BROADCAST_TERMS:
        return rows.join(F.broadcast(small), on)
    dealt = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(dealt, [on, "_salt"]).drop("_salt")


def _renamed(df: DataFrame, columns: tuple[str, ...] = KEY) -> DataFrame:
    """``df`` with other names for its keys: both sides of a join may come from one stored table."""
    return df.withColumnsRenamed({c: f"_{c}" for c in columns})


def _same(columns: tuple[str, ...] = KEY) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])


def _by_key(rows: DataFrame, told: DataFrame, size: int, how: str) -> DataFrame:
    """``rows`` joined with one row for each key; repeated rows of one key stay where they are, or land in many tasks.

    ``size`` is what ``told`` holds: its rows and their entries.
    """
    right = _renamed(told)
    if size <= BROADCAST_TERMS:
        return rows.join(F.broadcast(right), _same(), how)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    right = right.withColumn("_dealt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(right, _same() & (F.col("_salt") == F.col("_dealt")), how)


def term_counts(corpus: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, n): occurrences in the corpus of each test term that it holds."""
    tokens = corpus.select(F.explode(words(F.col("text"))).alias("word")).select(F.lower("word").alias("term"))
    if n_terms <= BROADCAST_TERMS:
        return tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return tokens.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term")


def _ranked(words_of: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """(key, n_terms, least, r): the terms of each row with count and offset, rarest first; least is 0 if one is absent."""
    each = words_of.select(key, F.size("terms").alias("n_terms"), F.posexplode("terms").alias("offset", "word"))
    each = each.withColumn("term", F.lower("word")).join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = F.sort_array(F.collect_list(F.struct("n", "term", "offset")))
    return each.groupBy(key, "n_terms").agg(rarest.alias("r"), F.min("n").alias("least"))


def _other(ranked: Column) -> Column:
    """The rarest entry of another term than the first's; the first itself if there is none."""
    return F.coalesce(F.get(F.filter(ranked, lambda x: x["term"] != ranked[0]["term"]), F.lit(0)), ranked[0])


def questions(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, item_id, n_terms, term, offset, term2, offset2): each distinct phrase that can occur, and each item.

    ``phrase`` is null for an item, ``item_id`` for a phrase. The term is the rarest one, the second term the
    next rarest of another kind (of a phrase of one word only the same again).
    """
    by_phrase = _ranked(windows.select("phrase", "terms").distinct(), "phrase", counts).where("least > 0")
    terms = windows.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    by_item = _ranked(terms, "item_id", counts).withColumn("r", F.filter("r", lambda x: x["n"] > 0)).where(F.size("r") > 1)
    first, second = F.col("r")[0], _other(F.col("r"))
    columns = [x[name].alias(name + end) for x, end in ((first, ""), (second, "2")) for name in ("term", "offset")]
    near = by_item.select("item_id", "n_terms", *columns).where("term != term2")
    return by_phrase.select("phrase", "n_terms", *columns).unionByName(near, allowMissingColumns=True)


def position_lists(corpus: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, doc_id, text_key, positions): the index of some terms, a sorted list for each document."""
    tokens = corpus.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(words(F.col("text"))).alias("position", "word"))
    hits = _join(tokens.withColumn("term", F.lower("word")).drop("word"), terms, "term", n_terms)
    return hits.groupBy("term", *KEY).agg(F.sort_array(F.collect_set("position")).alias("positions"))


def answers(lists: DataFrame, asked: DataFrame, n_asked: int, slop: int = SLOP) -> DataFrame:
    """(doc_id, text_key, phrase, n_terms, item_id, starts, near) of each question that a document may answer.

    ``starts`` are the places where both terms of a phrase stand at their offsets; ``near`` tells whether both
    terms of an item are within ``slop`` words of each other.
    """
    first = _join(lists, asked, "term", n_asked).withColumnRenamed("positions", "one")
    second = lists.select(F.col("term").alias("term2"), *KEY, F.col("positions").alias("two"))
    both = first.join(_renamed(second, ("term2", *KEY)), _same(("term2", *KEY)))
    adjusted = lambda name, offset: F.transform(name, lambda p: p - F.col(offset))
    starts = F.filter(F.array_intersect(adjusted("one", "offset"), adjusted("two", "offset2")), lambda p: p >= 0)
    tagged = lambda name, tag: F.transform(name, lambda p: F.struct(p.alias("p"), F.lit(tag).alias("tag")))
    both = both.withColumn("merged", F.when(F.col("item_id").isNotNull(), F.sort_array(F.concat(tagged("one", 1), tagged("two", 2)))))
    before = lambda i: F.get("merged", i - 1)
    close = F.filter("merged", lambda x, i: (before(i)["tag"] != x["tag"]) & (x["p"] - before(i)["p"] <= slop))
    return both.select(*KEY, "phrase", "n_terms", "item_id", F.when(F.col("phrase").isNotNull(), starts).alias("starts"), (F.size(close) > 0).alias("near"))


def phrase_matches(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text_key, phrase, start, n_terms): every exact occurrence of a phrase.

    ``found`` are the starts that lists left over. They are gathered per document, as many as it has words, and
    checked against the words of these documents only, each once.
    """
    places = found.where(F.size("starts") > 0).select(*KEY, "phrase", "n_terms", F.explode("starts").alias("start"))
    wanted = cut(places.groupBy(*KEY).agg(F.collect_set(F.struct("phrase", "start", "n_terms")).alias("places")))
    texts = corpus.withColumn("text_key", F.xxhash64("text"))
    held = _by_key(texts, wanted.select(*KEY), wanted.count(), "left_semi").select("doc_id", "text", "text_key").dropDuplicates(list(KEY))
    each = held.join(_renamed(wanted), _same()).select(*KEY, words(F.col("text")).alias("w"), "places")
    here = lambda x: _folded(F.array_join(F.slice("w", x["start"] + 1, x["n_terms"]), " "))
    return each.select(*KEY, F.explode(F.filter("places", lambda x: here(x) == x["phrase"])).alias("m")).select(*KEY, "m.phrase", "m.start", "m.n_terms")


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (start, end) spans, ends exclusive."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("reach"))

    def step(a: Column, x: Column) -> Column:
        more = F.greatest(x["end"] - F.greatest(x["start"], a["reach"]), F.lit(0)).cast("long")
        return F.struct((a["n"] + more).alias("n"), F.greatest(a["reach"], x["end"]).alias("reach"))

    return F.aggregate(spans, start, step, lambda a: a["n"])


class Index:
    """The index of a corpus for a benchmark: stored position lists and the matches over them."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int, slop: int):
        self.corpus = id_and_text(docs, id_col, text_col)
        self.windows = cut(query_windows(benchmark, item_col, item_text, window))
        terms = cut(self.windows.select(F.explode(F.transform("terms", F.lower)).alias("term")).distinct())
        counts = cut(term_counts(self.corpus, terms, terms.count()))
        self.questions = cut(questions(self.windows, counts))
        rare = cut(self.questions.select(F.explode(F.array("term", "term2")).alias("term")).distinct())
        self.lists = cut(position_lists(self.corpus, rare, rare.count()))
        self.answers = cut(answers(self.lists, self.questions, self.questions.count(), slop))
        self.matches = cut(phrase_matches(self.corpus, self.answers))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", window: int = WINDOW, slop: int = SLOP,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) of every row of ``docs``.

    ``n_hit`` counts words inside exact matches; ``n_near`` the items whose two rarest terms (of those that the
    corpus holds) stand within ``slop`` words of each other.
    """
    index = Index(docs, benchmark, id_col, text_col, item_col, item_text, window, slop)
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n_terms")).alias("end"))))
    hits = index.matches.groupBy(*KEY).agg(_covered(spans).alias("n_hit"))
    by_item = index.windows.select("phrase", F.col("item_id").cast("string").alias("item"))
    named = _join(index.matches.select(*KEY, "phrase").distinct(), by_item, "phrase", by_item.count())
    items = named.groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    near = index.answers.where("near").groupBy(*KEY).agg(F.count_distinct("item_id").alias("n_near"))
    parts = [hits.select(*KEY, "n_hit"), items.select(*KEY, "items"), near.select(*KEY, "n_near")]
    told = cut(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy(*KEY).agg(
        F.max("n_hit").alias("n_hit"), F.max("items").alias("items"), F.max("n_near").alias("n_near")
    ))
    size = told.agg(F.coalesce(F.sum(F.greatest(F.size("items"), F.lit(1))), F.lit(0))).first()[0]
    word = words(F.col("text"))
    empty_ends = F.when(F.size(word) == 1, (word[0] == "").cast("int")).otherwise(
        (word[0] == "").cast("int") + (F.element_at(word, -1) == "").cast("int")
    )
    rows = index.corpus.select("doc_id", F.xxhash64("text").alias("text_key"), (F.size(word) - empty_ends).cast("long").alias("n_words"))
    out = _by_key(rows, told, size, "left")
    items_or_none = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_or_none).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_or_none, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without any exact match of a benchmark window; rows of one id, nulls too, go together."""
    hit = contamination(docs, benchmark, id_col, text_col, **how).where("contaminated").select(F.col("doc_id").alias("id")).distinct()
    nulls = hit.where("id is null").limit(1).count()
    kept = without(docs, id_col, hit)
    return kept.where(F.col(f"`{id_col}`").isNotNull()) if nulls else kept
