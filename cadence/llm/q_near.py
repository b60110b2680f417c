"""Queries of the operators that compare texts: near duplicates, repeated strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.minhash import near_duplicates
from cadence.llm.substring_dedup import substring_dedup


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))



def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept", F.sha2("kept", 256)).withColumnRenamed("kept", "kept_sha256")


#: Pairs are found by the exact prefix rule: of two sets that are similar enough, the rarest
#: n - ceil(0.85 n) + 1 shingles of each have one in common.
NEAR_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF w <> ''] AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
  FROM words),
cells AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
freq AS (SELECT x, count(*) AS f FROM cells GROUP BY x),
ranked AS (
  SELECT doc_id, n, x, f, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS k FROM cells JOIN freq USING (x)),
heads AS (SELECT doc_id, n, x FROM ranked WHERE f > 1 AND k <= n - (85 * n + 99) // 100 + 1),
pairs AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM heads a JOIN heads b ON a.x = b.x AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
both_of AS (
  SELECT p.a, p.b, len(u.s) AS na, len(v.s) AS nb, len(list_intersect(u.s, v.s)) AS common
  FROM pairs p JOIN sets u ON u.doc_id = p.a JOIN sets v ON v.doc_id = p.b),
near AS (SELECT a, b FROM both_of WHERE 100 * common >= 85 * (na + nb - common)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN comp USING (doc_id)
"""
