"""Queries of the quality-rule ledger."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import quality_rules
from storyloom.llm.common import shared_folder, table


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measurements, failure bits and the default policy's verdict."""
    judged = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", *quality_rules.MEASURES, "fail_bits", "base_failed", "kept")


QUERIES = {"op2_quality_rules": op2_quality_rules}

ORACLES = {
    "op2_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM (
    SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (
      SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w))),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (
  SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM win WHERE n > 1) GROUP BY rid),
l AS (
  SELECT rid, count(*) AS n, count(DISTINCT x) AS nd,
    count(*) FILTER (WHERE regexp_matches(x, '^[\x20\x09]*[-*•]')) AS nb,
    count(*) FILTER (WHERE regexp_matches(x, '(\.\.\.|…)\s*$')) AS ne
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(l.n - l.nd, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(l.n, 0)::BIGINT AS n_lines, len(regexp_extract_all(t, '!+'))::BIGINT AS n_shouts,
    coalesce(l.nb, 0)::BIGINT AS n_bullet_lines, coalesce(l.ne, 0)::BIGINT AS n_ellipsis_lines,
    len(regexp_extract_all(t, chr(65533)))::BIGINT AS n_replacement
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN l USING (rid)),
b AS (
  SELECT *, (
      CASE WHEN n_words < 50 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    | CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
    | CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    | CASE WHEN 100 * n_shouts > 20 * n_words THEN 16 ELSE 0 END
    | CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END | CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END
    | CASE WHEN n_lines >= 4 AND 100 * n_bullet_lines > 90 * n_lines THEN 128 ELSE 0 END
    | CASE WHEN n_lines >= 4 AND 100 * n_ellipsis_lines > 50 * n_lines THEN 256 ELSE 0 END
    | CASE WHEN 100 * n_replacement > 5 * n_words THEN 512 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""
}


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does, read from a ledger that was written once."""
    stored = quality_rules.write_ledger(table(spark, sf_dir, "documents"), f"{shared_folder(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}")
    each = [quality_rules.ablations(stored, policy).withColumn("policy", F.lit(policy)) for policy in quality_rules.POLICIES]
    return reduce(DataFrame.unionByName, each)


QUERIES["quality_ablations"] = quality_ablations
_RULES = ", ".join(
    f"('{policy}', '{rule}', {quality_rules.BITS[rule]}, {quality_rules.mask(names)})" for policy, names in quality_rules.POLICIES.items() for rule in names
)
ORACLES["quality_ablations"] = f"""SELECT policy, rule, count_if(fail_bits & bit <> 0)::BIGINT AS n_failed, count_if(fail_bits & mask = bit)::BIGINT AS n_only,
  count_if(fail_bits & mask = 0)::BIGINT AS n_kept, count_if(fail_bits & (mask - bit) = 0)::BIGINT AS n_kept_without
FROM (SELECT fail_bits FROM ({ORACLES['op2_quality_rules']})), (VALUES {_RULES}) r(policy, rule, bit, mask) GROUP BY policy, rule"""
