"""Language of web pages by fusing evidence in Bayes' rule.

For each language l: log P(l | page) = text + log P(declared | l) + log P(suffix | l) + log P(l | host) + const.

* text: byte-trigram log-likelihoods of the visible text, over three as neighbouring trigrams overlap;
* declared: the language that the markup names. How far it can be trusted is counted on the pages themselves,
  as sums of text posteriors by declared value;
* suffix: the last label of the host, counted likewise;
* host prior: posteriors summed by host, smoothed towards its domain, and that towards all pages. A page's own
  share is taken out of its host's sums, so no page confirms itself.

All counts are grouped aggregations with partial sums. They are joined back once, by host: hosts that many pages
have are few and broadcast, so a host with a third of all pages is no single task.
The trigram model is fitted on a bounded sample of each language: its documents fall into ``TRAIN_ROWS`` buckets
by the hash of their id, and the one with the least hash of each bucket is taken; of texts longer than
``TRAIN_CHARS`` four slices, evenly spread (both are parameters of ``fit``). A task counts a language's trigrams; the driver gets
its counts as 256 KB of numbers. All languages are kept; their table goes to the workers as a broadcast, 256 KB for each.

Defined results: null html has no text and no declaration; a null or odd url has an empty host, whose prior is
that of all pages; the language that a page declares is that of its first ``html`` tag; script, style and comments
that are never closed are text; character numbers of nine digits or more are no characters; equal posteriors go to
the language first in alphabetical order; repeated rows each get a row and count each; an empty table gives no
rows, an empty corpus null languages; extra columns are ignored. Pages of any length are read in one pass and
scored in slices.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import cut, join_counted, per_batch

TRAIN_ROWS, TRAIN_CHARS = 200, 16_384
BUCKETS, SMOOTH, OVERLAP, STRENGTH = 1 << 16, 0.1, 3.0, 4.0
HIDDEN = re.compile(r"(?i)<(?:!--|(script|style|noscript|template)\b)")
CLOSED = {"!--": re.compile("-->")} | {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "noscript", "template")}
HTML = re.compile(r"(?i)<html\b")
DECLARED = re.compile(r"""(?i)\blang\s*=\s*["']?([a-z]+)""")
NO_CHARACTER = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
SLICE = 1 << 20


def _shown(markup: str) -> str:
    """The markup without scripts, styles and comments. What isn't closed once is never looked for again."""
    out, at, open_for_good = [], 0, set()
    found = HIDDEN.search(markup)
    while found:
        kind, end = (found[1] or "!--").lower(), found.end()
        closed = None if kind in open_for_good else CLOSED[kind].search(markup, end)
        if closed:
            out.append(markup[at : found.start()])
            at = end = closed.end()
        else:
            open_for_good.add(kind)
        found = HIDDEN.search(markup, end)
    return " ".join([*out, markup[at:]])


def visible_text(markup: str) -> str:
    markup, out, at = _shown(markup), [], 0
    while (start := markup.find("<", at)) >= 0 and (end := markup.find(">", start)) >= 0:
        out.append(markup[at:start])
        at = end + 1
    return " ".join(html.unescape(NO_CHARACTER.sub("\ufffd", " ".join([*out, markup[at:]]))).split())


def declared_language(markup: str) -> str | None:
    """The language that the first html tag names, in lower case."""
    if not (tag := HTML.search(markup)):
        return None
    end = markup.find(">", tag.end())
    found = DECLARED.search(markup, tag.end(), end if end >= 0 else len(markup))
    return found[1].lower() if found else None


def trigrams(text: str) -> np.ndarray:
    """Bucket numbers of the byte trigrams of a text in lower case, with a blank on both sides."""
    octets = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    packed = octets[:-2] << 16 | octets[1:-1] << 8 | octets[2:]
    return (packed * np.uint32(2654435761)) >> np.uint32(16)


def sampled(text: str, chars: int | None = TRAIN_CHARS) -> list[str]:
    """The text, or of a longer one four slices of ``chars`` characters in all, evenly spread over it; None for whole texts."""
    if chars is None or len(text) <= chars:
        return [text]
    size = chars // 4
    return [text[at : at + size] for at in (k * (len(text) - size) // 3 for k in range(4))]


def model_of(counts: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """(languages in alphabetical order, log-likelihoods by bucket and language) from trigram counts by language."""
    languages = sorted(counts)
    table = np.full((BUCKETS, max(len(languages), 1)), SMOOTH)
    for k, name in enumerate(languages):
        table[:, k] += counts[name]
    return languages, np.log(table / table.sum(axis=0)).astype(np.float32)


def train(texts: list[str], labels: list[str]) -> tuple[list[str], np.ndarray]:
    """The model of some labelled texts."""
    counts: dict[str, np.ndarray] = {}
    for text, label in zip(texts, labels, strict=True):
        for part in sampled(text):
            counts[label] = counts.get(label, 0) + np.bincount(trigrams(part), minlength=BUCKETS)
    return model_of(counts)


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, chars: int | None = TRAIN_CHARS,
) -> tuple[list[str], np.ndarray]:
    """The trigram model of the sample described above: ``rows`` documents of each language at most, ``chars`` characters of each."""
    known = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    keys = known.select("lang", "id", F.xxhash64("id").alias("h"))
    least = F.min(F.struct("h", F.col("id").alias("least_id"))).alias("least")
    chosen = keys.groupBy("lang", F.pmod("h", F.lit(rows)).alias("bucket")).agg(least)
    chosen = chosen.select(F.col("lang").alias("of_lang"), "least.least_id")
    same = (F.col("lang") == F.col("of_lang")) & F.col("id").eqNullSafe(F.col("least_id"))
    found = known.join(F.broadcast(chosen), same)  # as many ids of each language as rows are asked for, at most
    texts_of = found.groupBy("lang", "id").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in sampled(text, chars):
                    held[lang] = held.get(lang, 0) + np.bincount(trigrams(part), minlength=BUCKETS)
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([counts.astype(np.int32).tobytes()], pa.binary())], ["lang", "counts"])

    # The sample of a language is bounded, so one task counts it.
    told = texts_of.repartition("lang").mapInArrow(count, "lang string, counts binary").toArrow()
    return model_of({lang.as_py(): np.frombuffer(counts.as_buffer(), np.int32) for lang, counts in zip(told["lang"], told["counts"], strict=True)})


def evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, domain, suffix, declared, n_chars, loglik) of every row; declared is a known language, other or none."""
    languages, known = model[0], set(model[0])
    shared = pages.sparkSession.sparkContext.broadcast(model[1])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, out = shared.value, []
        for url, markup in zip(batch.column(1), batch.column(2), strict=True):
            found, markup = HOST.match(url.as_py() or ""), markup.as_py() or ""
            host = found[1].lower().strip(".") if found else ""
            labels = host.split(".")
            named = declared_language(markup)
            declared = "none" if named is None else named if named in known else "other"
            text = visible_text(markup)
            loglik = np.zeros(len(languages))
            for at in range(0, len(text), SLICE):
                loglik += table[trigrams(text[at : at + SLICE])].sum(axis=0, dtype=np.float64)
            out.append((host, ".".join(labels[-2:]), labels[-1], declared, len(text), loglik.tolist()))
        kinds = (*[pa.string()] * 4, pa.int64(), pa.list_(pa.float64()))
        columns = [pa.array(list(x), type=t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page_id", "host", "domain", "suffix", "declared", "n_chars", "loglik"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = "page_id long, host string, domain string, suffix string, declared string, n_chars long, loglik array<double>"
    return rows.mapInArrow(per_batch(run), schema)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _softmax(logits: Column) -> Column:
    return _let(logits, lambda own: _let(F.array_max(own), lambda most: F.transform(own, lambda x: F.exp(x - most))))


def _normal(values: Column) -> Column:
    return _let(values, lambda own: _let(_total(own), lambda total: F.transform(own, lambda x: x / total)))


def _sums(df: DataFrame, keys: list[str], values: Column, name: str) -> DataFrame:
    """(keys, n, name): how many rows have the keys, and their arrays summed.

    Places of the arrays are summed as rows, map-side first; a plan with a sum for each place would grow with the languages.
    """
    each = df.select(*keys, F.posexplode(F.concat(values, F.array(F.lit(1.0)))).alias("_at", "_x"))
    summed = each.groupBy(*keys, "_at").agg(F.sum("_x").alias("_x"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda x: x["_x"])
    rows = summed.groupBy(*keys).agg(held.alias("_held"))
    return rows.select(*keys, F.element_at("_held", -1).cast("long").alias("n"), F.slice("_held", F.lit(1), F.size("_held") - 1).alias(name))


def _plus(a: Column, b: Column, sign: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def _smoothed(own: Column, above: Column) -> Column:
    """Shares of ``own`` drawn towards ``above`` with a fixed strength."""
    drawn = lambda mine: lambda total: F.zip_with(mine, above, lambda x, y: (x + STRENGTH * y) / (total + STRENGTH))
    return _let(own, lambda mine: _let(_total(mine), drawn(mine)))


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, n_chars) of every row."""
    languages, _ = model
    n = len(languages)
    names = F.array(*[F.lit(x) for x in languages]) if n else F.array().cast("array<string>")
    if not n:
        rows = evidence(pages, model, id_col, url_col, html_col)
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
                           F.lit(None).cast("string").alias("text_lang"), "declared", "n_chars")
    seen = evidence(pages, model, id_col, url_col, html_col).withColumn("logits", F.transform("loglik", lambda x: x / OVERLAP))
    seen = cut(seen.withColumn("post", _normal(_softmax(F.col("logits")))))
    held = {r["at"]: r["x"] for r in seen.select(F.posexplode("post").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()}  # a row for each language
    everything = [held.get(k, 0.0) for k in range(n)]
    total = F.array(*[F.lit(float(x)) for x in everything])
    base = F.array(*[F.lit((x + 1) / (sum(everything) + n)) for x in everything])
    # P(value | language), smoothed by one page of each value that occurs.
    given = {}
    for key in ("declared", "suffix"):
        values = seen.select(key).distinct().count()
        given[key] = _sums(seen, [key], F.col("post"), f"{key}_sum").select(
            key, F.zip_with(f"{key}_sum", total, lambda x, t: F.log((x + 1) / (t + values))).alias(f"{key}_log")
        )
    # Host, domain and suffix are summed and joined on rows of hosts, then once with the pages.
    places = ["host", "domain", "suffix"]
    hosts = cut(_sums(seen, places, F.col("post"), "host_sum"))
    of_domain = cut(_sums(hosts, ["domain"], F.col("host_sum"), "domain_sum"))
    of_suffix = cut(hosts.groupBy("suffix").agg(F.count("*").alias("n")).join(given["suffix"], "suffix"))
    n_pages, n_hosts = seen.count(), hosts.count()
    told = hosts.select(*places, "host_sum", F.col("n").alias("pages"))
    told = join_counted(join_counted(told, of_domain, "domain", n_hosts), of_suffix, "suffix", n_hosts)
    told = cut(told.withColumnRenamed("pages", "n").drop("domain", "suffix"))
    # declared has a value for each language, other and none
    joined = join_counted(seen.join(F.broadcast(given["declared"]), "declared"), told, "host", n_pages)
    domain = _smoothed(_plus(F.col("domain_sum"), F.col("post"), -1.0), base)
    host = _smoothed(_plus(F.col("host_sum"), F.col("post"), -1.0), F.col("domain_prior"))
    joined = joined.withColumn("domain_prior", F.when(F.col("host") == "", base).otherwise(domain))
    joined = joined.withColumn("prior", F.when(F.col("host") == "", base).otherwise(host))
    sums = F.zip_with("logits", F.transform("prior", lambda x: F.log(F.greatest(x, F.lit(1e-12)))), lambda x, y: x + y)
    sums = _plus(_plus(sums, F.col("declared_log")), F.col("suffix_log"))
    fused = joined.withColumn("sums", sums).withColumn("fused", _normal(_softmax(F.col("sums"))))
    best = F.array_max("fused")
    return fused.select(
        "page_id", F.get(names, F.array_position("fused", best).cast("int") - 1).alias("lang"), best.alias("probability"),
        F.get(names, F.array_position("post", F.array_max("post")).cast("int") - 1).alias("text_lang"), "declared", "n_chars",
    )
