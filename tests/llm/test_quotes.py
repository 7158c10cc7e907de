"""Quotation linking against a plain version and its SQL, on generated conversations."""

from __future__ import annotations

import random
import re

import duckdb

from storyloom.llm import quotes, quotes_queries
from tests.oracle import rows_of

SCHEMA = "conv_id long, turn long, role string, text string"
LINES = ["Yes.", "A longer line of some words", "yes.", "Où est-il ?", "one  two\tthree", "", "Last line here", "No, never", "It  IS so"]


def _generated():
    rng = random.Random(8)
    rows = []
    for conv in range(60):
        said = []
        for turn in range(rng.randrange(1, 9)):
            own = "\n".join(rng.choices(LINES, k=rng.randrange(1, 5)))
            parts = []
            if said and rng.random() < 0.8:
                for level in range(rng.randrange(1, 4)):
                    earlier = rng.choice(said).split("\n")
                    if rng.random() < 0.4:
                        earlier = rng.sample(earlier, k=rng.randrange(1, len(earlier) + 1))
                    mark = rng.choice(["> ", ">", " > "]) * (level + 1)
                    parts += [rng.choice(["Anna wrote:", "Le 3 mai, Jean a écrit :", "so:"])] * rng.randrange(2)
                    parts.append("\n".join(mark + x.upper() if rng.random() < 0.3 else mark + x for x in earlier))
            parts.insert(rng.randrange(len(parts) + 1), own)
            said.append(own)
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["\n", "\n\n", "\r\n"]).join(parts)))
    rows += rng.sample(rows, 12)  # repeated messages
    return rows + [(70, 0, "user", None), (70, None, "user", "> x"), (None, 1, "user", "Yes."), (None, 2, "user", "> Yes.")]


def _passages(text):
    normal = lambda x: re.sub(r"[ \t\n\x0b\f\r]+", " ", x).strip(" ").lower()
    return {normal(x) for x in [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]} - {""}


def _plain(raw):
    """(own text, {level: passages}) of a message."""
    lines = []
    for x in re.split(r"\r?\n", raw or ""):
        m = re.match(r"((?:[ \t]*>)+)[ \t]?", x)
        lines.append((m[1].count(">"), x[m.end() :]) if m else (0, x))
    levels = {k for k, _ in lines if k}
    if not levels:
        return raw or "", {}
    own = [x for i, (k, x) in enumerate(lines) if not k and not (i + 1 < len(lines) and lines[i + 1][0] and re.search(r"(?i)(wrote|schrieb|a écrit|escribió) ?:[ \t]*$", x))]
    text = re.sub(r"\n([ \t]*\n){2,}", "\n\n", "\n".join(own)).strip(" \t\n")
    return text, {k: _passages("\n".join(x if level == k else "" for level, x in lines)) for k in levels}


def test_generated_conversations(spark):
    rows = _generated()
    found = quotes.formatted(quotes.conversations(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    parsed = [(c, t, role, *_plain(raw)) for c, t, role, raw in rows]
    first, asked = {}, {}
    for c, t, _, text, _ in parsed:
        for p in _passages(text) if c is not None and t is not None else ():
            first[c, p] = min(t, first.get((c, p), t))
    for c, t, _, _, levels in parsed:
        for k, passages in levels.items() if c is not None and t is not None else ():
            for p in passages:
                if first.get((c, p), t) < t:
                    asked.setdefault((c, t), {})[p] = min(k, asked.get((c, t), {}).get(p, k))
    parent = {key: max((-k, len(p), first[key[0], p]) for p, k in hits.items())[2] for key, hits in asked.items()}
    assert len(parent) > 100 and len({k for hits in asked.values() for k in hits.values()}) > 1
    wanted = []
    for c, t, role, text, levels in parsed:
        root, depth = t, 0
        while (c, root) in parent:
            root, depth = parent[c, root], depth + 1
        wanted.append((c, t, role, text, parent.get((c, t)), root, depth, sum(map(len, levels.values())), len(asked.get((c, t), ())), f"<|{role or 'user'}|>\n{text}\n"))
    names = ["conv_id", "turn", "role", "text", "parent_turn", "root_turn", "depth", "n_quoted", "n_linked", "formatted"]
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r[n] for n in names)) for r in found.collect())
    connection = duckdb.connect()
    connection.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    connection.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    told = connection.sql(quotes_queries.ORACLES["op3_quotation_links"])
    assert rows_of(found.columns, found.collect()) == rows_of(told.columns, told.fetchall())


def test_a_longer_passage_decides(spark):
    rows = [(1, 0, "u", "The plan is good enough"), (1, 1, "a", "Yes."), (1, 2, "u", "> The plan is good enough\n> Yes.\nok")]
    found = {r["turn"]: r["parent_turn"] for r in quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[2] == 0


def test_a_long_text_of_marks(spark):
    rows = [(1, 0, "u", "x y\n" * 50_000), (1, 1, "a", "> x y\n" * 50_000 + "done"), (1, 2, "u", ">" * 100_000), (1, 3, "u", " >" * 3 + " \t" * 100_000)]
    found = {r["turn"]: r for r in quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1]["parent_turn"] == 0 and found[1]["text"] == "done" and found[2]["text"] == ""
