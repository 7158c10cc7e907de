"""Query of quotation linking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import quotes
from storyloom.llm.common import table


def op3_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes as chat text, with the message it replies to and its thread."""
    return quotes.formatted(quotes.conversations(table(spark, sf_dir, "conversations")))


QUERIES = {"op3_quotation_links": op3_quotation_links}

_MARKS = r"^(?:[ \t]*>)+[ \t]?"
_INTRO = r"(?i)(wrote|schrieb|a écrit|escribió) ?:[ \t]*$"


def _normal(text: str) -> str:
    return rf"lower(trim(regexp_replace({text}, '[ \t\n\x0B\f\r]+', ' ', 'g')))"


def _passages(text: str) -> str:
    return (
        f"list_distinct(list_filter(list_transform(list_concat([{text}], string_split_regex({text}, '\\n[ \\t]*\\n'), string_split({text}, chr(10))), "
        f"lambda y: {_normal('y')}), lambda y: y <> ''))"
    )


ORACLES = {
    "op3_quotation_links": rf"""
WITH RECURSIVE r AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS raw FROM conversations),
l AS (
  SELECT rid, i, x, len(regexp_replace(regexp_extract(x, '{_MARKS}'), '[^>]', '', 'g')) AS level,
    regexp_replace(x, '{_MARKS}', '') AS line
  FROM (SELECT rid, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT rid, string_split_regex(raw, '\r?\n') AS ls FROM r))),
o AS (
  SELECT rid, max(level) AS deepest,
    string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT (next > 0 AND regexp_matches(line, '{_INTRO}'))) AS body
  FROM (SELECT *, coalesce(lead(level) OVER (PARTITION BY rid ORDER BY i), 0) AS next FROM l) GROUP BY rid),
m AS (
  SELECT rid, conv_id, turn, role, CASE WHEN deepest = 0 THEN raw
    ELSE trim(regexp_replace(coalesce(body, ''), '\n([ \t]*\n){{2,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) END AS text
  FROM r JOIN o USING (rid)),
lv AS (
  SELECT rid, k, string_agg(CASE WHEN level = k THEN line ELSE '' END, chr(10) ORDER BY i) AS t
  FROM l JOIN (SELECT DISTINCT rid, level AS k FROM l WHERE level > 0) USING (rid) GROUP BY rid, k),
q AS (SELECT rid, k, unnest({_passages('t')}) AS p FROM lv),
own AS (SELECT conv_id, p, min(turn) AS first_turn FROM (SELECT conv_id, turn, unnest({_passages('text')}) AS p FROM m) GROUP BY conv_id, p),
hit AS (
  SELECT conv_id, turn, k, length(p) AS size, first_turn FROM (SELECT conv_id, turn, p, min(k) AS k FROM q JOIN m USING (rid) GROUP BY ALL) JOIN own USING (conv_id, p)
  WHERE first_turn < turn),
par AS (SELECT conv_id, turn, max(n) AS n_linked, max(first_turn) FILTER (WHERE place = 1) AS parent_turn
  FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS n,
      row_number() OVER (PARTITION BY conv_id, turn ORDER BY k, size DESC, first_turn DESC) AS place FROM hit) GROUP BY conv_id, turn),
up AS (
  SELECT conv_id, turn, parent_turn AS root_turn, 1 AS depth FROM par
  UNION ALL SELECT up.conv_id, up.turn, par.parent_turn, up.depth + 1 FROM up JOIN par ON par.conv_id = up.conv_id AND par.turn = up.root_turn),
top AS (SELECT conv_id, turn, arg_max(root_turn, depth) AS root_turn, max(depth) AS depth FROM up GROUP BY conv_id, turn)
SELECT m.conv_id, coalesce(top.root_turn, m.turn) AS root_turn, m.turn, m.role, m.text, par.parent_turn, coalesce(top.depth, 0)::BIGINT AS depth,
  (SELECT count(*) FROM q WHERE q.rid = m.rid)::BIGINT AS n_quoted, coalesce(par.n_linked, 0)::BIGINT AS n_linked,
  '<|' || coalesce(m.role, 'user') || '|>' || chr(10) || m.text || chr(10) AS formatted
FROM m LEFT JOIN par ON par.conv_id = m.conv_id AND par.turn = m.turn LEFT JOIN top ON top.conv_id = m.conv_id AND top.turn = m.turn
"""
}
