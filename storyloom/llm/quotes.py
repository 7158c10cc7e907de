"""Chat formatting by quotation linking, DataFrame functions only.

A message's lines have a quote level: how many ``>`` they begin with. The unquoted rest is the message's own
text. Passages of the own text (the whole, each paragraph, each line; lower case, white space folded) are
hashed and summed to the first message of the conversation that has them. Quoted passages, hashed the same way
level by level, join them: the shallowest linked level names the message replied to, and within it the latest
original. Parents are followed up to the thread's first message by pointer jumping, so a conversation ordered
by (root_turn, turn) has every reply after what it replies to, and no quotes.

Nothing gathers a conversation: originals are pre-aggregated per (conversation, passage), links are joined by
key, and the result has one row per message.

Defined results: a null text is empty; null conversations or turns are never linked (each row is a root of its
own); repeated rows each get a row; of several messages with one turn number the passages count together; an
empty table gives no rows; extra columns are ignored. A quote that has no earlier original stays unlinked and
is removed like the others; a line that introduces a quote ("... wrote:") goes with it. Texts of any length are
parsed whole within their row, in time linear in the text for each quote level that it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import cut

#: The marks of a line. Repetitions are of single characters only: a repeated group would nest calls as deep as a text is long.
MARKS, MANY_EMPTY = r"^([ \t>]*>)[ \t]?", r"\n[ \t]*\n[ \t\n]*\n"
#: What ends a line that introduces a quote, in the languages of the test data.
INTRODUCES = r"(?i)(wrote|schrieb|a écrit|escribió) ?:[ \t]*$"


def _normal(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"\s+", " ")))


def _passages(text: Column, level: Column) -> Column:
    """(level, size, passage) of the whole text, its paragraphs and its lines, without empty ones; a passage is a hash."""
    parts = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, r"\n"))
    told = F.array_distinct(F.filter(F.transform(parts, _normal), lambda x: x != ""))
    return F.transform(told, lambda x: F.struct(level.alias("level"), F.length(x).alias("size"), F.md5(x).alias("passage")))


def parsed(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, passages, n_quoted): text without quotes; own passages at level 0, and quoted ones."""
    rows = messages.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("raw"),
    )
    marks = lambda x: F.regexp_extract(x, MARKS, 1)
    line = lambda x: F.struct(
        F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")
    )
    rows = rows.withColumn("lines", F.transform(F.split("raw", r"\r?\n"), line))
    rows = rows.withColumn("levels", F.array_distinct(F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: x["level"])))
    next_level = lambda i: F.coalesce(F.get("lines", i + 1)["level"], F.lit(0))
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~((next_level(i) > 0) & x["line"].rlike(INTRODUCES)))
    body = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), MANY_EMPTY, "\n\n")
    rows = rows.withColumn("text", F.when(F.size("levels") == 0, F.col("raw")).otherwise(F.btrim(body, F.lit(" \t\n"))))
    at_level = lambda k: F.array_join(F.transform("lines", lambda x: F.when(x["level"] == k, x["line"]).otherwise("")), "\n")
    rows = rows.withColumn("quoted", F.flatten(F.transform("levels", lambda k: _passages(at_level(k), k))))
    both = F.concat(_passages(F.col("text"), F.lit(0)), "quoted")
    return rows.select("conv_id", "turn", "role", "text", both.alias("passages"), F.size("quoted").cast("long").alias("n_quoted"))


def links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, n_linked): the message that each quoting message replies to."""
    each = cut(rows.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.*"))
    originals = each.where("level = 0").groupBy("conv_id", "passage").agg(F.min("turn").alias("first_turn"))
    quotes = each.where("level > 0").groupBy("conv_id", "passage", "turn").agg(F.min("level").alias("level"), F.max("size").alias("size"))
    found = quotes.join(originals, ["conv_id", "passage"]).where("first_turn < turn")
    best = F.max(F.struct((-F.col("level")).alias("near"), "size", "first_turn"))
    return found.groupBy("conv_id", "turn").agg(best["first_turn"].alias("parent_turn"), F.count("*").alias("n_linked"))


def roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of every message that has a parent; doubling the distance each round."""
    reach = cut(parents.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = reach.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        joined = cut(reach.join(above, ["conv_id", "up"], "left"))
        if not joined.where(F.col("further").isNotNull()).limit(1).count():
            return reach.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth")
        reach = joined.select(
            "conv_id", "turn", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        )


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, root_turn, turn, role, text, parent_turn, depth, n_quoted, n_linked) of every message."""
    rows = parsed(messages, conv, turn, role, text)
    found = cut(links(rows))
    up = roots(found)
    key = ["conv_id", "turn"]
    joined = rows.join(found, key, "left").join(up, key, "left")
    return joined.select(
        "conv_id", F.coalesce("root_turn", "turn").alias("root_turn"), "turn", "role", "text", "parent_turn",
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quoted",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )


def formatted(rows: DataFrame, opening: str = "<|{role}|>\n", closing: str = "\n") -> DataFrame:
    """Messages with ``formatted``, the chat text: the role's mark, then the text; order by (conv_id, root_turn, turn) to read."""
    before, after = opening.split("{role}")
    mark = F.concat(F.lit(before), F.coalesce("role", F.lit("user")), F.lit(after), F.col("text"), F.lit(closing))
    return rows.withColumn("formatted", mark)
