"""Language identification: hostile pages, many languages, long training texts, conflicting evidence, a hot host."""

from __future__ import annotations

import random
import time

import pytest

from storyloom.llm import language

WORDS = {"en": "the of and to in is that for it was".split(), "de": "der die und das ist nicht ein von mit sich".split(), "fr": "le de et la les des est une dans pour".split()}
SIZE = 4_000_000


def _said(rng, lang, k):
    return " ".join(rng.choices(WORDS[lang], k=k))


@pytest.mark.parametrize("part", ["<script>", "<!--", "<html ", "<html lang ", "<", "&#1", "<style></style", "</script ", "<a <b"])
def test_pages_are_read_in_one_pass(part):
    page = part * (SIZE // len(part))
    began = time.process_time()
    language.visible_text(page)
    language.declared_language(page)
    language.HOST.match("https://" + page)
    assert time.process_time() - began < 8


def test_visible_text():
    shown = language.visible_text
    assert shown("a<script>x</script >b<!-- c -->d<b title='e'>f</b>") == "a b d f"
    assert shown("<SCRIPT>x<style>y</style>") == "x" and shown("a < b") == "a < b"
    assert shown("&amp;&#65;&#" + "9" * 5000 + ";") == "&A�"
    named = language.declared_language
    assert named("<p><HTML xml:lang='DE'>") == "de" and named("<html><p lang=fr>") is None and named("<html lang=") is None


def test_every_language_is_kept_and_long_texts_are_sampled(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:03d}": ["".join(rng.choices(letters, k=4)) for _ in range(8)] for k in range(80)}
    rows = [(k * 10 + i, " ".join(rng.choices(words, k=5000 if k % 2 else 30)), lang) for k, (lang, words) in enumerate(own.items()) for i in range(4)]
    languages, table = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert languages == sorted(own) and table.shape == (language.BUCKETS, 80)
    for lang, words in own.items():
        found = table[language.trigrams(" ".join(rng.choices(words, k=40)))].sum(axis=0)
        assert languages[int(found.argmax())] == lang


def test_fusion_decides_where_evidence_conflicts(spark):
    rng = random.Random(5)
    model = language.train([_said(rng, lang, 300) for lang in WORDS for _ in range(5)], [lang for lang in WORDS for _ in range(5)])
    pages = []
    for i in range(300):  # one host has a third of all pages
        lang = list(WORDS)[i % 3] if i >= 100 else "de"
        host = "big.example.de" if i < 100 else f"h{i}.example.{ {'en': 'com', 'de': 'de', 'fr': 'fr'}[lang] }"
        pages.append((i, f"https://{host}/{i}", f"<html lang={lang}><p>{_said(rng, lang, 30)}"))
    pages += [
        (900, "https://big.example.de/x", "<html><p>xyz"),  # no text to speak of: host and suffix decide
        (901, "https://other.example.fr/x", "<html lang=fr><p>qqq"),  # suffix and declared language decide
        (902, "https://big.example.de/y", f"<html lang=de><p>{_said(rng, 'fr', 60)}"),  # a long text outweighs both
        (903, None, f"<p>{_said(rng, 'en', 5)}"),
    ]
    found = {r["page_id"]: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert len(found) == len(pages) and [found[i]["lang"] for i in (900, 901, 902, 903)] == ["de", "fr", "fr", "en"]
    assert any(found[i]["lang"] != found[i]["text_lang"] for i in (900, 901))
    assert all(found[i]["lang"] == p[2][11:13] for i, p in enumerate(pages[:300]))


def test_two_hundred_languages(spark):
    """Time and plan don't grow with the square of the languages, and the driver gets no rows of counts."""
    rng, n = random.Random(1), 200
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(40)] for _ in range(n)]
    say = lambda k, size: " ".join(rng.choice(words[k]) for _ in range(size))
    docs = [(k, say(k % n, 60), f"l{k % n:03d}") for k in range(2 * n)]
    pages = [(k, f"https://h{k % 7}.org/x", f"<html lang=x><p>{say(k % n, 30)}</p></html>") for k in range(2 * n)]
    model = language.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), chars=None)
    assert len(model[0]) == n and model[1].shape == (language.BUCKETS, n)
    found = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()
    assert all(r["lang"] == f"l{r['page_id'] % n:03d}" and r["declared"] == "other" for r in found) and len(found) == 2 * n


def test_fit_takes_its_bounds(spark):
    rows = [(k, "ab " * 50 + "zz " * 50, "en") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, whole = (language.fit(docs, rows=r, chars=c)[1] for r, c in ((1, 40), (200, None)))
    assert (few != whole).any() and (language.fit(docs, rows=1, chars=None)[1] == language.train([rows[0][1]], ["en"])[1]).all()
