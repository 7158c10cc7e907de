"""Query of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import decontaminate
from storyloom.llm.common import table


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words and items of the benchmark that it holds, and the items that it is near to."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontamination": op7_decontamination}

ORACLES = {
    "op7_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS phrase, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
p AS (
  SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM (
    SELECT rid, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS s FROM d, (SELECT DISTINCT n FROM q))),
m AS (SELECT DISTINCT rid, s, p.n, item_id FROM p JOIN q USING (phrase)),
h AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS j FROM m) GROUP BY rid),
t AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM m) GROUP BY rid),
tok AS (SELECT rid, j, lower(w[j]) AS term FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
rare AS (
  SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY n, term) AS k
  FROM (SELECT DISTINCT item_id, lower(x) AS term FROM (SELECT item_id, unnest(w) AS x FROM i))
  JOIN (SELECT term, count(*) AS n FROM tok GROUP BY term) USING (term)),
pair AS (SELECT a.item_id, a.term AS one, b.term AS two FROM rare a JOIN rare b ON a.item_id = b.item_id AND a.k = 1 AND b.k = 2),
held AS (SELECT * FROM tok WHERE term IN (SELECT one FROM pair UNION ALL SELECT two FROM pair)),
near AS (
  SELECT a.rid, count(DISTINCT item_id) AS n_near
  FROM pair JOIN held a ON a.term = one JOIN held b ON b.rid = a.rid AND b.term = two AND abs(a.j - b.j) <= 16 GROUP BY a.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid) LEFT JOIN near USING (rid)
"""
}
