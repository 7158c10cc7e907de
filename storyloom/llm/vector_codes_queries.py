"""Query of vector codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import vector_codes
from storyloom.llm.common import table


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code and errors of every vector, and the digest of the codebooks."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES = {"op12_vector_codes": op12_vector_codes}

_ASSIGN = """
a{k} AS MATERIALIZED (
  SELECT i, p, arg_min(e, [d, e]) AS e, min(d) AS d FROM (
    SELECT i, x.p, b.e, list_sum(list_transform(range(1, len(x.x) + 1), lambda j: (x.x[j] - b.c[j]) * (x.x[j] - b.c[j])))::BIGINT AS d
    FROM x JOIN b{k} b ON x.p = b.p) GROUP BY i, p)"""
_REFINE = """
m{k} AS (
  SELECT p, e, list(s ORDER BY j) AS c FROM (
    SELECT p, e, j, floor(sum(v)::DECIMAL(38, 0) / count(*))::BIGINT AS s FROM (
      SELECT x.p, a.e, unnest(range(1, len(x.x) + 1)) AS j, unnest(x.x) AS v FROM x JOIN a{k} a ON x.i = a.i AND x.p = a.p) GROUP BY p, e, j) GROUP BY p, e),
b{next} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e)"""

ORACLES = {
    "op12_vector_codes": r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS i, vec_id, label,
    list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (
  SELECT i, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM v, (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, i AS e, x AS c FROM x WHERE i < 64),"""
    + ",".join([_ASSIGN.format(k=0), _REFINE.format(k=0, next=1), _ASSIGN.format(k=1), _REFINE.format(k=1, next=2), _ASSIGN.format(k=2)])
    + r""",
c AS (SELECT i, string_agg(format('{:02x}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY i),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM v JOIN c USING (i), h
"""
}
