"""Quality rules as a bitmask ledger, DataFrame functions only.

Every rule is evaluated once per document. The ledger row keeps the measurements and one failure bit per
rule; a *policy* is a named, versioned set of rules, so applying another policy or asking what a rule costs
(``ablations``) reads the ledger and never the text again.

Defined results: a null text counts as an empty one (no words, fails ``few_words``); repeated rows each get
their own ledger row; extra columns are carried through ``ledger`` untouched only if asked for with ``keep``.
An empty table gives an empty ledger. Texts of any length are handled whole: all work is within the row and
linear or n log n in its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import WORD_SPACE, id_and_text

#: A window's hash, of the word x at place i and the next two.
WINDOW_HASH = "xxhash64(x, get(_words, i + 1), get(_words, i + 2))"
SPLIT_WORDS = r"[\x20\x09-\x0D]+"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_bullet_lines",
    "n_ellipsis_lines", "n_replacement",
)


@dataclass(frozen=True)
class Rule:
    """A rule fails a document where ``fails`` (SQL over the measurements) is true; ``bit`` never changes."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 20 * n_words"),
    Rule("duplicate_lines", 3, "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("shouting", 4, "100 * n_shouts > 20 * n_words"),
    Rule("short_words", 5, "word_chars < 2 * n_words"),
    Rule("long_words", 6, "word_chars > 20 * n_words"),
    Rule("bullets", 7, "n_lines >= 4 AND 100 * n_bullet_lines > 90 * n_lines"),
    Rule("ellipses", 8, "n_lines >= 4 AND 100 * n_ellipsis_lines > 50 * n_lines"),
    Rule("broken_encoding", 9, "100 * n_replacement > 5 * n_words"),
)
BITS = {rule.name: 1 << rule.bit for rule in RULES}
#: A document is a base failure if it has one of these.
BASE = ("few_words", "repeated_words")
#: Policies by version; a version is never edited, a new one is added.
POLICIES = {
    "base-1": BASE,
    "prose-1": (*BASE, "symbols", "shouting", "duplicate_lines"),
    "prose-2": tuple(rule.name for rule in RULES),
}
DEFAULT_POLICY = "prose-2"


def mask(names: tuple[str, ...] | list[str]) -> int:
    """The bits of some rules."""
    return sum(BITS[name] for name in set(names))


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the measurements of ``text_col``.

    Words are runs without ASCII white space. ``n_repeat_words`` counts words inside a three-word window that
    occurs twice or more in the text. Each window becomes one long: the upper bits are a hash of its words, the
    lower ones its position. Sorted, equal windows are neighbours, and the words themselves decide equality. Only
    where different words have one hash, which could stand between equal ones, the windows are sorted by their words.
    """
    columns = df.columns
    df = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("_trimmed", F.btrim("_text", F.lit(WORD_SPACE)))
    df = df.withColumns(
        {
            "_words": F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", SPLIT_WORDS)),
            "_lines": F.expr(f"filter(split(_text, '\\n'), x -> btrim(x, '{_sql(WORD_SPACE)}') != '')"),
        }
    )
    df = df.withColumns({"_n": F.size("_words"), "_pos_bits": F.length(F.bin(F.size("_words").cast("long")))})
    df = df.withColumn(
        "_windows",
        F.expr("""sort_array(transform(slice(_words, 1, greatest(_n - 2, 0)), (x, i) ->
            shiftleft(shiftright("""
            + WINDOW_HASH
            + ", _pos_bits), _pos_bits) | i))"),
    )
    equal_hash = "shiftright(x ^ {y}, _pos_bits) = 0"
    low = "cast({} & (shiftleft(1L, _pos_bits) - 1) as int)"
    place = low.format("x")
    # Windows that share their hash with a neighbour; in most texts these are few.
    either = " OR ".join(f"coalesce({equal_hash.format(y=f'get(_windows, i {k} 1)')}, false)" for k in "-+")
    df = df.withColumn("_alike", F.expr(f"filter(_windows, (x, i) -> {either})"))
    before = "get(_alike, i - 1)"
    other = low.format(before)
    same_words = " AND ".join(f"get(_words, {place} + {k}) = get(_words, {other} + {k})" for k in range(3))
    differ = f"coalesce({equal_hash.format(y=before)}, false) AND NOT ({same_words})"
    df = df.withColumn("_collide", F.expr(f"size(filter(_alike, (x, i) -> {differ})) > 0"))
    df = df.withColumn("_by_words", F.expr(f"CASE WHEN _collide THEN sort_array(transform(_alike, x -> struct(slice(_words, {place} + 1, 3) AS w, {place} AS p))) END"))
    neighbours = "x.w = get(_by_words, i - 1).w OR x.w = get(_by_words, i + 1).w"
    exact = f"sort_array(transform(filter(_by_words, (x, i) -> coalesce({neighbours}, false)), x -> x.p))"
    df = df.withColumn("_repeats", F.expr(f"CASE WHEN _collide THEN {exact} ELSE sort_array(transform(_alike, x -> {place})) END"))
    measures = {
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_trimmed", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.expr(
            "aggregate(transform(_repeats, (p, i) -> least(3, coalesce(get(_repeats, i + 1), p + 3) - p)), 0L, (a, x) -> a + x)"
        ),
        "n_lines": F.size("_lines").cast("long"),
        "n_shouts": F.regexp_count("_trimmed", F.lit("!+")).cast("long"),
        "n_bullet_lines": F.expr(r"size(filter(_lines, x -> x rlike '^[\\x20\\x09]*[-*•]'))").cast("long"),
        "n_ellipsis_lines": F.expr(r"size(filter(_lines, x -> x rlike '(\\.\\.\\.|…)\\s*$'))").cast("long"),
        "n_replacement": F.regexp_count("_trimmed", F.lit("�")).cast("long"),
    }
    # One row from one row: a filter on what is measured stays above this, else it would be pushed below all
    # of these steps and repeat them.
    once = F.explode(F.array(F.struct(*[c.alias(n) for n, c in measures.items()]))).alias("_m")
    return df.select(*[F.col(_quoted(c)) for c in columns], once).select(*[F.col(_quoted(c)) for c in columns], "_m.*")


def _sql(text: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in text)


def with_bits(df: DataFrame) -> DataFrame:
    """Measured rows with ``fail_bits``: one bit for each rule, each evaluated once."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return df.withColumn("fail_bits", bits)


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, fail_bits) of every row."""
    return with_bits(measured(id_and_text(df, id_col, text_col))).select("doc_id", *MEASURES, "fail_bits")


def apply_policy(ledger_df: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and the policy's name, from the bits alone."""
    bits = F.col("fail_bits")
    return ledger_df.withColumns(
        {
            "base_failed": bits.bitwiseAND(F.lit(mask(BASE))) != 0,
            "kept": bits.bitwiseAND(F.lit(mask(POLICIES[policy]) | mask(BASE))) == 0,
            "policy": F.lit(policy),
        }
    )


def ablations(ledger_df: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else, and kept with and without it.

    The ledger is first summed by its distinct bit patterns, so what is exploded is patterns, not documents.
    """
    active = mask(POLICIES[policy])
    patterns = ledger_df.groupBy(F.col("fail_bits").bitwiseAND(F.lit(active)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("long").alias("bit")) for name in POLICIES[policy]])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    failed, others = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not("bit")) != 0
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).alias
    return each.groupBy("rule").agg(
        count(failed)("n_failed"), count(failed & ~others)("n_only"), count(F.col("bits") == 0)("n_kept"), count(~others)("n_kept_without")
    )


def write_ledger(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored ledger of ``df`` in a folder of the shared store: rules are evaluated once, policies and ablations read this."""
    ledger(df, id_col, text_col).write.parquet(folder)
    return read_ledger(df.sparkSession, folder)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(", ".join(["doc_id long", *(f"{m} long" for m in MEASURES), "fail_bits long"])).parquet(folder)


def keep_passing(df: DataFrame, policy: str = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that a policy keeps, with their own columns; nothing is shuffled."""
    columns = [F.col(f"_row.{_quoted(name)}").alias(name) for name in df.columns]
    rows = df.select(F.struct(*[F.col(_quoted(name)) for name in df.columns]).alias("_row"), F.col(text_col).cast("string").alias("text"))
    return apply_policy(with_bits(measured(rows)), policy).where("kept").select(*columns)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
